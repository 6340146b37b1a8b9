"""A folder that tasks write to and a commit publishes: on any file system that
pyarrow opens.  Tasks write under a staging folder of their job; what a reader
sees is moved there by the commit on the driver."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyarrow import fs

STAGING = "_staging"


class Folder:
    """All paths are those of the folder's file system."""

    def __init__(self, folder: str) -> None:
        self.fs, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.path = path.rstrip("/")

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != fs.FileType.NotFound

    def staging(self, job: str) -> str:
        path = f"{self.path}/{STAGING}/{job}"
        self.fs.create_dir(path)
        return path

    def unstage(self, job: str) -> None:
        """Deletes what the job's tasks have left, those that were killed too."""
        if self.exists(f"{self.path}/{STAGING}/{job}"):
            self.fs.delete_dir(f"{self.path}/{STAGING}/{job}")

    def sweep(self, age: timedelta = timedelta(days=1)) -> None:
        """Deletes staging folders without a change for ``age``: those of killed
        tasks that wrote on after their job had been aborted."""
        before = datetime.now(timezone.utc) - age
        for f in self.fs.get_file_info(fs.FileSelector(f"{self.path}/{STAGING}", allow_not_found=True)):
            if f.mtime is not None and f.mtime <= before:
                self.fs.delete_dir(f.path)
