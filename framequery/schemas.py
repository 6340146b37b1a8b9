"""Schemas of the tables that the operators take."""

from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType


def _struct(**fields: object) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


POINT = _struct(x=DoubleType(), y=DoubleType())
FRAME = _struct(camera_id=LongType(), frame_no=LongType(), ts=TimestampType(), height=IntegerType(), width=IntegerType(), n_channels=IntegerType(), mode=StringType(), data=BinaryType())  # noqa: E501
RAW_PRED = _struct(camera_id=LongType(), frame_no=LongType(), anchor_idx=LongType(), cx=DoubleType(), cy=DoubleType(), w=DoubleType(), h=DoubleType(), scores=ArrayType(DoubleType()))  # noqa: E501
DETECTION = _struct(camera_id=LongType(), frame_no=LongType(), det_idx=LongType(), track_id=LongType(), cls_id=LongType(), conf=DoubleType(), x1=DoubleType(), y1=DoubleType(), x2=DoubleType(), y2=DoubleType())  # noqa: E501
REGION = _struct(region_id=LongType(), name=StringType(), polygon=ArrayType(POINT), xmin=DoubleType(), ymin=DoubleType(), xmax=DoubleType(), ymax=DoubleType())  # noqa: E501
MESSAGE = _struct(topic=StringType(), value=StringType())
