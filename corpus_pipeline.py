"""From raw documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of `docs`.

Defined results in every stage: a null text is the empty text; a null id, source or language is a value like
others; rows may be equal, and texts may have any length; an empty table gives an empty one; columns beyond
those of `documents` are kept, whatever their names (but those that begin with two underscores, and what the
last stage returns, are the pipeline's own).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from cadenza.llm.common import Scratch, collected_scratch, delete_folders, grown, table, text_of
from cadenza.llm.queries import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_KEY = "__textid"
#: What stages left in the shared folder for the results that they returned: (application, thread, tables) ->
#: (number of the stage, folders).
_left: dict[tuple[str, int, str], tuple[int, list[str]]] = {}


def _stage(number: int) -> Callable[[Stage], Stage]:
    """A stage that first deletes what its predecessor in this thread left for its result, which has been
    written and read again by then. What a stage of any other run left stays."""

    def wrap(f: Stage) -> Stage:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            run = (spark.sparkContext.applicationId, get_ident(), sf_dir)
            before, folders = _left.pop(run, (0, []))
            if before == number - 1:
                delete_folders(spark, folders)
            with collected_scratch() as folders:
                out = f(spark, docs, sf_dir)
            _left[run] = (number, folders)
            return out

        return run_stage

    return wrap


@_stage(1)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go, those without words among them; equal rows stay or go together."""
    # the verdict depends on the text alone and is made in place: nothing is joined or shuffled
    judged = quality_rules.ledger(docs.select(F.struct(*docs.columns).alias("doc_id"), F.col("text").alias("text")))
    kept = quality_rules.apply_policy(judged, quality_rules.POLICIES[-1]).where("kept")
    return kept.select(*(F.col("doc_id")[c].alias(c) for c in docs.columns))


@_stage(2)
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 stays, that with the least doc_id (a null id
    is the greatest; of one id that with the least hash of its text); equal rows are one."""
    linked = ngram_join.near_duplicates(docs, words=5, num=80, den=100)
    leaders = linked.where("leader").groupBy("doc_id", "textid").agg(F.max(F.col("n_shingles") == 0).alias("__empty"))
    leaders = leaders.select(F.col("doc_id").alias("__doc"), F.col("textid").alias(_KEY), "__empty")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text_of()) == F.col(_KEY))
    kept = docs.join(grown(leaders), same).select(*docs.columns, "__doc", _KEY, "__empty")
    # equal rows are one group; texts without words are linked with nothing
    one = kept.where("not __empty").dropDuplicates(["__doc", _KEY])
    return kept.where("__empty").unionByName(one).select(*docs.columns)


@_stage(3)
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand in several places go; what is left of a text stays, and
    the bytes of a character that was cut in two go too. Documents with nothing left go."""
    cut = suffix_dedup.remove_repeats(docs, out="__removal", decode=True)
    touched = F.col("__removal")["n_removed"] > 0
    text = F.when(touched, F.col("__removal")["kept_text"]).otherwise(F.col("text"))
    out = cut.withColumn("__text", text).where(~touched | (F.length(F.btrim("__text")) > 0))
    changed = {"text": F.col("__text"), "n_chars": F.when(touched, F.length("__text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


@_stage(4)
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stays as often as the mix takes it, at most twice; null is
    the last source."""
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text", "source"), F.array("source"), carry=("__row",))
    taken = mixed.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return taken.select(*(F.col("__row")[c].alias(c) for c in docs.columns))


@_stage(5)
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a longer document is cut, an empty one is its end token."""
    return packing.pack(spark, docs, TOKENIZER)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", passages),
    ("mixing sources", mixture),
    ("best-fit packing", sequences),
]

#: Tokens, suffix sorting and packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a table in the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    scratch, last = Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
