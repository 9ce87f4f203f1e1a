"""Row-wise Column functions (F1-F28). All built-in expressions, no Python UDF."""

from dealbook.functions.dates import first_of_month, try_date
from dealbook.functions.numeric import (
    round_half_away, safe_pct, share_pct, to_int, try_number, variance_pct,
)
from dealbook.functions.text import (
    composite_key, file_name_parts, label_concat, month_text, ratio_codes,
    starts_with_total, text_right, zero_pad,
)
from dealbook.functions.format import accounting, month_label, percent_text, sign_class

__all__ = [
    "first_of_month", "try_date", "round_half_away", "safe_pct", "share_pct", "to_int",
    "try_number", "variance_pct", "composite_key", "file_name_parts", "label_concat",
    "month_text", "ratio_codes", "starts_with_total", "text_right", "zero_pad",
    "accounting", "month_label", "percent_text", "sign_class",
]
