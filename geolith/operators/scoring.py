"""Scorers: a linear one in column expressions, and the neural one as a vectorised function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geolith.functions.math import softmax
from geolith.operators.features import FEATURES, LAST_CODE

#: Stand-in weights in the order of FEATURES; trained ones are a parameter.
WEIGHTS = (1.0, -0.3, -0.7, -2.0, -1.0, 1.0, 1.0, 1.0, 0.7)
BERT, COUNTRY, CODE, MIX = 768, 24, 8, 24


def linear_scores(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """rows of packed slots with score, a softmax within the mention of the weighted features."""
    logit = F.aggregate(F.zip_with("features", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda acc, x: acc + x)
    return rows.withColumn("logit", logit).withColumn("score", softmax(F.col("logit"), Window.partitionBy("doc_id", "mention_id"))).drop("logit")


def random_weights(countries: int, seed: int = 0, bert: int = BERT, country: int = COUNTRY, code: int = CODE, mix: int = MIX) -> dict[str, np.ndarray]:
    """Weights of the neural scorer's shapes; a trained set is loaded from a file."""
    rng = np.random.default_rng(seed)
    shapes = {
        "code_emb": (LAST_CODE + 1, code), "country_emb": (countries, bert), "country_w": (country, bert), "country_b": (country,), "text_country_w": (country, bert), "text_country_b": (country,),
        "context_w": (country, bert), "context_b": (country,), "text_code_w": (code, bert), "text_code_b": (code,), "mix1_w": (mix, 13), "mix1_b": (mix,), "mix2_w": (mix, mix), "mix2_b": (mix,),
        "last_w": (1, mix), "last_b": (1,), "country_head": (countries, country),
    }
    return {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1) / np.maximum(np.linalg.norm(a, axis=-1) * np.linalg.norm(b, axis=-1), 1e-8)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(w: dict[str, np.ndarray], place: np.ndarray, locs: np.ndarray, doc: np.ndarray, codes: np.ndarray, countries: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mentions, slots) probabilities and (mentions, countries) of the country head.

    place, locs and doc are (mentions, 768), codes and countries (mentions, slots), features (mentions, slots, 9).
    """
    x = place @ w["text_country_w"].T + w["text_country_b"]
    x_code = place @ w["text_code_w"].T + w["text_code_b"]
    x_locs, x_doc = (v @ w["context_w"].T + w["context_b"] for v in (locs, doc))
    cc = w["country_emb"][countries] @ w["country_w"].T + w["country_b"]
    sims = [_cosine(x[:, None], cc), _cosine(x_code[:, None], w["code_emb"][codes]), _cosine(x_locs[:, None], cc), _cosine(x_doc[:, None], cc)]
    h = np.concatenate([np.stack(sims, -1), features], -1)
    h = _sigmoid(h @ w["mix1_w"].T + w["mix1_b"])
    h = _sigmoid(h @ w["mix2_w"].T + w["mix2_b"])
    return _softmax((h @ w["last_w"].T + w["last_b"])[..., 0]), _softmax(_sigmoid(x) @ w["country_head"].T)


def neural_scores(slots: DataFrame, vectors: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """slots (packed) with score: doc_id, mention_id, slot, score.

    vectors: doc_id, mention_id, tensor, doc_tensor, locs_tensor. Weights are sent to executors once.
    """
    shared = slots.sparkSession.sparkContext.broadcast(weights)
    rows = slots.groupBy("doc_id", "mention_id").agg(F.array_sort(F.collect_list(F.struct("slot", "code_idx", "country_idx", "features"))).alias("s")).join(vectors, ["doc_id", "mention_id"])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby(pdf["s"].map(len)):
                stack = lambda c: np.array(part[c].tolist(), np.float64)  # noqa: B023, E731
                own = [[(x["code_idx"], x["country_idx"]) for x in s] for s in part["s"]]
                idx = np.array(own, int).reshape(len(part), n, 2)
                feats = np.array([[list(x["features"]) for x in s] for s in part["s"]], np.float64)
                score, _ = forward(shared.value, stack("tensor"), stack("locs_tensor"), stack("doc_tensor"), idx[..., 0], idx[..., 1], feats)
                yield pd.DataFrame({"doc_id": part["doc_id"].repeat(n).to_numpy(), "mention_id": part["mention_id"].repeat(n).to_numpy(), "slot": np.tile(np.arange(n), len(part)), "score": score.ravel()})

    return rows.mapInPandas(go, "doc_id long, mention_id int, slot int, score double")


def country_scores(vectors: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, mention_id, countries (probability of each country number): the country head, which looks at the mention's vector alone."""
    shared = vectors.sparkSession.sparkContext.broadcast({k: weights[k] for k in ("text_country_w", "text_country_b", "country_head")})

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for pdf in batches:
            x = np.array(pdf["tensor"].tolist(), np.float64).reshape(len(pdf), -1) @ w["text_country_w"].T + w["text_country_b"]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "mention_id": pdf["mention_id"], "countries": list(_softmax(_sigmoid(x) @ w["country_head"].T))})

    return vectors.select("doc_id", "mention_id", "tensor").mapInPandas(go, "doc_id long, mention_id int, countries array<double>")


assert len(WEIGHTS) == len(FEATURES)
