from stockflow.functions.columns import (  # noqa: F401
    clip_keep_null, max0, nan_to_null, null_if_na_token, rupees, title_case, week_end,
)
