from tallyho.functions.scalar import (fmt_comparison, fmt_duration, impact_direction, or_na,
                                      pct_diff, round_half_even, run_stamp, yes_no)

__all__ = ["fmt_comparison", "fmt_duration", "impact_direction", "or_na", "pct_diff",
           "round_half_even", "run_stamp", "yes_no"]
