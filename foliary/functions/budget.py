"""Token budgets of the routing and answer requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.params import Params


def token_budget(profiles: DataFrame, params: Params) -> DataFrame:
    """Nine budget fields and an error per profile.

    `profiles` holds router_context, router_output, answer_context and answer_output; a null or
    non-positive limit means the configured default.
    """

    def limit(name: str, default: int) -> Column:
        return F.when(F.col(name) > 0, F.col(name)).otherwise(F.lit(default)).cast("long")

    def reserve(available: Column) -> Column:
        percent = min(max(params.navigation_context_safety_percent, 1), 25)
        share = F.floor(available * percent / F.lit(100))
        return F.least(F.greatest(F.lit(1024), share), F.greatest(F.lit(1), F.floor(available / F.lit(4))))

    def side(prefix: str, context_cap: int, output_cap: int) -> tuple[Column, Column, Column]:
        context = F.least(limit(f"{prefix}_context", context_cap), F.lit(context_cap))
        output = F.least(
            limit(f"{prefix}_output", output_cap),
            F.lit(output_cap),
            F.greatest(F.lit(1), F.floor(context / F.lit(4))),
        )
        return context, output, context - output

    context, output, available = side(
        "router", params.query_router_context_tokens, params.navigation_default_max_output_tokens
    )
    answer_context, answer_output, answer_available = side(
        "answer", params.answer_context_tokens, params.answer_max_output_tokens
    )
    router_input = available - reserve(available)
    evidence = answer_available - reserve(answer_available)
    values = {
        "context_window": context,
        "root_budget": F.least(router_input, F.lit(params.navigation_root_input_token_cap)),
        "folder_budget": F.least(router_input, F.lit(params.navigation_folder_input_token_cap)),
        "evidence_budget": evidence,
        "output_reserve": output,
        "answer_context_window": answer_context,
        "answer_output_reserve": answer_output,
        "router_safety_reserve": reserve(available),
        "answer_safety_reserve": reserve(answer_available),
    }
    error = (
        F.when(available < 12, F.lit("router context too small"))
        .when(router_input < 1, F.lit("router input budget too small"))
        .when(answer_available < 12, F.lit("answer context too small"))
        .when(evidence < 1, F.lit("evidence budget too small"))
    )
    return profiles.select(
        "*", *[v.cast("long").alias(k) for k, v in values.items()], error.alias("error")
    )
