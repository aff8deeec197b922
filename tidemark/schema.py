"""Table shapes. Order is data here, so every table of samples has an explicit ``pos``."""

from pyspark.sql import types as T

INTERVAL = T.ArrayType(T.StructType([T.StructField("birth", T.DoubleType()), T.StructField("death", T.DoubleType())]))
NAMES = [("category", T.StringType()), ("video", T.StringType())]


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


FRAMES = _table(*NAMES, ("pos", T.IntegerType()), ("frame_idx", T.IntegerType()), ("ts", T.DoubleType()), ("features", T.ArrayType(T.FloatType())), ("h0", INTERVAL), ("h1", INTERVAL))
VIDEOS = _table(
    ("category", T.StringType()), ("source_path", T.StringType()), ("output_path", T.StringType()), ("num_frames", T.LongType()), ("native_fps", T.DoubleType()), ("sampled_fps", T.DoubleType()),
    ("duration_sec", T.DoubleType()), ("sample_stride_frames", T.DoubleType()), ("feature_dim", T.LongType()),
)
CURVE_FILES = _table(("category", T.StringType()), ("source_path", T.StringType()), ("output_path", T.StringType()), ("frames", T.LongType()))
NEIGHBOUR_FILES = _table(("tv_video", T.StringType()), ("output", T.StringType()))
DETECTIONS = _table(("det_id", T.LongType()), ("tv", T.StringType()), ("start", T.DoubleType()), ("length", T.DoubleType()), ("clip", T.StringType()), ("score", T.DoubleType()))
TRUTH = _table(("gt_id", T.LongType()), ("tv", T.StringType()), ("start", T.DoubleType()), ("length", T.DoubleType()), ("clip", T.StringType()))
#: Curves in the order of a frame's channels.
CURVES = ("h0_count", "h0_sum", "h0_max", "h0_std", "h1_count", "h1_sum", "h1_max", "h1_std", "brightness_mean", "brightness_std", "pi_energy", "combined_activity")
