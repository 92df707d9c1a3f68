"""Column-expression helpers that keep T-SQL semantics on Spark built-ins.

Everything here returns a ``Column`` made of built-in functions, so it stays
inside whole-stage codegen.
"""

from riskflow.functions.dates import (  # noqa: F401
    as_date, day_diff, month_boundaries, year_boundaries, yyyymm,
)
from riskflow.functions.strings import (  # noqa: F401
    folded, is_blank, not_blank_or, pad_right2, same_text, text_in,
)
from riskflow.functions.numeric import (  # noqa: F401
    clamp_upper, floor_zero, great_circle_miles, logistic, safe_ratio,
)
