"""Plan shapes shared by the operators: checked broadcasts, distributed ranks, exact quantiles."""
