"""Schemas of the tables that the stages hand to each other, as DDL."""


def _nested(ddl: str) -> str:
    """Columns as fields of a struct."""
    return ", ".join(f"{name}: {kind}" for name, kind in (c.split(" ", 1) for c in ddl.split(", ")))


MOVIE = "frame int, h int, w int, data array<float>"
PAGE = "frame int, h int, w int, samples int, label string, data binary"  # a byte a sample, row by row
PIXEL = "frame int, y int, x int, v double"
BOX = "struct<y0:int,y1:int,x0:int,x1:int>"
PATCH_SPEC = "name string, quadrant_row int, quadrant_col int, patch_row int, patch_col int, y0 int, y1 int, x0 int, x1 int"
CROP_PARA = f"version int, after_stitch boolean, pad int, patch_specs array<struct<{_nested(PATCH_SPEC)}>>"
ALIGNMENT = "struct<offset_y:double,offset_x:double,crop_bounds:array<int>,cropped_shape:array<int>>"
STITCH_PARA = ("version int, order string, pre_stitch_shape array<int>, estimation_frame array<int>, "
    f"left {ALIGNMENT}, right {ALIGNMENT}, final {ALIGNMENT}, crop_bounds array<int>, cropped_stitch_shape array<int>"
)
FOOTPRINT = "patch string, k int, p bigint, w float"
TRACE = "patch string, k int, c array<float>, yra array<float>"
BACKGROUND = "patch string, p bigint, v float"
RING = "patch string, p bigint, q bigint, w float"
PROFILE = ("patch string, component_index int, snr double, r_value double, bl double, lam double, neurons_sn double, "
    "g_0 double, g_1 double, t_peak double, t_half double, r_value_unreliable_joint_only boolean"
)
METRIC_STATS = "metric string, scale string, mean double, std double"
QC_SPEC = "key string, scale string, mean double, std double, lower_z double, upper_z double"
