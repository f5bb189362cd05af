from kestrel.functions.arrays import (  # noqa: F401
    dot_literal,
    log_policy,
    logistic,
    row_l2_normalise,
    soft_absolute,
    standardise,
)
