"""Parameter counts of a decoder-only transformer with grouped queries and a gated MLP, as arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameters(configs: DataFrame) -> DataFrame:
    """configs (hidden, heads, kv_heads, head_dim, inner, vocab, layers: longs; qk_norm, tied: booleans) with the parts and their total."""
    c: dict[str, Column] = {n: F.col(n).cast("long") for n in ("hidden", "kv_heads", "head_dim", "inner", "vocab", "layers")}
    d, kv = c["hidden"], c["kv_heads"] * c["head_dim"]
    attention, mlp, norms = 2 * d * d + 2 * d * kv, 3 * d * c["inner"], 2 * d
    qk = F.when(F.col("qk_norm"), d + kv).otherwise(F.lit(0).cast("long"))
    block, table = attention + mlp + norms + qk, c["vocab"] * d
    head = F.when(F.col("tied"), F.lit(0).cast("long")).otherwise(table)
    parts = {"attention_per_layer": attention, "mlp_per_layer": mlp, "norms_per_layer": norms, "qk_norm_per_layer": qk, "block_per_layer": block, "transformer_total": c["layers"] * block, "embedding": table, "final_norm": d, "output_head": head}
    return configs.select("*", *[v.alias(k) for k, v in parts.items()], (c["layers"] * block + table + d + head).alias("total"))
