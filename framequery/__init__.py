"""Video-perception analytics as DataFrame-to-DataFrame operators."""
