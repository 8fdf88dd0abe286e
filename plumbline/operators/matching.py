"""Free text to option: exact, then unique containment, then cosine, ties by the common tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.identity import TIE_NAMESPACE, tie_udf
from plumbline.functions.text import ws_case_key
from plumbline.functions.vectors import cosine, let

LEAST_CONTAINED = 4
LEAST_COSINE = 0.30


def _keyed(text: Column, options: Column) -> Column:
    """The keys of a text and its options (t, o: label and key x), made once however often they are compared."""
    return F.struct(ws_case_key(text).alias("t"), F.transform(options, lambda o: F.struct(o["label"].alias("label"), ws_case_key(o["text"]).alias("x"))).alias("o"))


def _hits(k: Column) -> Column:
    """(e, c): labels of the exact and of the contained options."""
    long = F.length(k["t"]) >= LEAST_CONTAINED
    contains = lambda o: (F.length(o["x"]) >= LEAST_CONTAINED) & (F.contains(k["t"], o["x"]) | (F.contains(o["x"], k["t"]) & long))
    labels = lambda hit: F.transform(F.filter(k["o"], hit), lambda o: o["label"])
    return F.struct(labels(lambda o: o["x"] == k["t"]).alias("e"), labels(contains).alias("c"))


def exact_hits(text: Column, options: Column) -> Column:
    """Labels of the options that equal the text but for letter case and white space."""
    return let(_keyed(text, options), _hits)["e"]


def contained_hits(text: Column, options: Column) -> Column:
    """Labels of the options (4 characters or more) that hold the text or lie within it; a shorter text only counts if it holds the option."""
    return let(_keyed(text, options), _hits)["c"]


def cosine_hits(vector: Column, options: Column, vectors: Column) -> Column:
    """Labels of the options whose vectors reach the largest cosine, if that is at least 0.30; equal values tie."""
    sims = F.transform(vectors, lambda v: cosine(vector, v))
    best = F.array_max(sims)
    pairs = F.zip_with(options, sims, lambda o, s: F.struct(o["label"].alias("label"), s.alias("s")))
    return F.when(best >= LEAST_COSINE, F.transform(F.filter(pairs, lambda p: p["s"] == best), lambda p: p["label"])).otherwise(F.array().cast("array<string>"))


def matched(df: DataFrame, text: str, options: str, vector: str | None = None, vectors: str | None = None) -> DataFrame:
    """``df`` plus stage (exact, contained, cosine or null) and tied (labels); blank and null texts and null options match nothing."""
    t, o = F.col(text), F.coalesce(F.col(options), F.array().cast(df.schema[options].dataType))
    none = F.array().cast("array<string>")
    usable = F.coalesce(F.trim(t), F.lit("")).rlike(r"(?U)\S")
    both = let(_keyed(t, o), _hits)
    near = cosine_hits(F.col(vector), o, F.col(vectors)) if vector and vectors else none
    def outcome(h: Column) -> Column:
        exact, contained = F.size(h["e"]) > 0, F.size(h["c"]) == 1
        stage = F.when(exact, "exact").when(contained, "contained").when(F.size(h["v"]) > 0, "cosine")
        return F.struct(stage.alias("stage"), F.when(exact, h["e"]).when(contained, h["c"]).otherwise(h["v"]).alias("tied"))

    nothing = F.struct(F.lit(None).cast("string").alias("stage"), none.alias("tied"))
    staged = let(F.struct(both.alias("b"), near.alias("v")), lambda p: outcome(F.struct(p["b"]["e"].alias("e"), p["b"]["c"].alias("c"), p["v"].alias("v"))))
    return df.select("*", F.when(usable, staged).otherwise(nothing).alias("__m")).select(*df.columns, "__m.stage", "__m.tied")


def match_options(df: DataFrame, text: str, options: str, benchmark: Column, question: Column, seed: int, method: str, vector: str | None = None, vectors: str | None = None, namespace: str = TIE_NAMESPACE) -> DataFrame:
    """``df`` plus stage and matched (one label or null); ties go through source indexes."""
    staged = matched(df, text, options, vector, vectors)
    clear = staged.where(F.size("tied") <= 1).withColumn("matched", F.get("tied", F.lit(0))).drop("tied")
    several = staged.where(F.size("tied") > 1)
    chosen = F.filter(F.col(options), lambda o: F.array_contains("tied", o["label"]))
    won = several.withColumn("__t", chosen).withColumn("__w", tie_udf(seed, method, namespace)(benchmark, question, F.transform("__t", lambda o: o["source_index"].cast("int"))))
    broken = won.withColumn("matched", F.get(F.filter("__t", lambda o: o["source_index"] == F.col("__w")), F.lit(0))["label"]).drop("__t", "__w", "tied")
    return clear.unionByName(broken)
