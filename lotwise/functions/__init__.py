from lotwise.functions.scalar import (  # noqa: F401
    clip_low,
    col,
    hash_bucket,
    hash_number,
    pearson,
    quality_points,
    safe_ratio,
    size_class,
    strip,
)
