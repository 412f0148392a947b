"""Schemas of the relational form of workbooks."""

CELLS = (
    "workbook string, sheet string, sheet_idx int, row int, col int, formula string, value_type string, value_num double, is_int boolean, "
    "value_str string, value_bool boolean, value_ts timestamp, number_format string, merged boolean"
)
NAMED_RANGES = "workbook string, name string, refers_to string, scope string"
SKIPPED = "workbook string, sheet string, row int, col int, reason string"
MERGED = "workbook string, sheet string, r0 int, c0 int, r1 int, c1 int"
GROUND_TRUTH = "entry string, base_shape string, cell string, state string, rule_id string, note string"
CELL_NAMES = [part.split()[0] for part in CELLS.split(", ")]
