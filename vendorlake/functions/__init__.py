from vendorlake.functions.names import (  # noqa: F401
    decompressed_name,
    decompressed_name_col,
    glob_match,
    glob_to_regex,
    sanitize_col,
    sanitize_header,
)
from vendorlake.functions.money import exact_total, money_difference, money_sum  # noqa: F401
