"""Column expressions shared by the operators."""

from .columns import (
    bce_with_logits,
    cell_start,
    code_slug,
    draw_key,
    draw_number,
    from_micros,
    interval_days,
    list_fingerprint,
    micros,
    sigmoid,
    years,
)
from .exact import exact_sum

__all__ = [
    "bce_with_logits",
    "cell_start",
    "code_slug",
    "draw_key",
    "draw_number",
    "exact_sum",
    "from_micros",
    "interval_days",
    "list_fingerprint",
    "micros",
    "sigmoid",
    "years",
]
