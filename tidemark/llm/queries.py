"""The thin queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licenses, neardup, packing, pii, quality, shards, suffix, winnow


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = quality.scores(docs, *quality.model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % quality.FOLDS == quality.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_and_next(_documents(spark, sf_dir))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.report(_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary())


#: Documents have no paths; a source is taken for a directory, with a folder for every so many ids.
FOLDER = 100


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.floor(F.coalesce("doc_id", F.lit(0)) / FOLDER).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), folder, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    files = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("id", "doc_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    made = chat.format_rows(rows.unionByName(planted))
    read = made.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("read"), chat.loss_text(F.col("formatted"), F.col("turns")).alias("loss"))
    listed = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(_documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_fingerprints, op4_repeats, op5_packing, op6_licenses, op7_chat, op8_near_duplicates, op9_decontam, op10_shards)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE = {
    "op9_decontam": f"""
with d as (select doc_id, {_WORDS} as words from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as words from benchmark),
win as (
  select distinct item, case when len(words) >= 10 then words[i:i + 9] else words end as w
  from b, unnest(generate_series(1, greatest(1, len(words) - 9))) as s(i) where len(words) > 0),
lens as (select distinct len(w) as n from win),
grams as (
  select doc_id, n, i, words[i:i + n - 1] as w
  from d, lens, unnest(generate_series(1, len(words) - n + 1)) as s(i)),
m as (select distinct g.doc_id, g.i, g.n, win.item from grams g join win on g.w = win.w),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from m) group by 1),
its as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by 1)
select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)""",
    "op7_chat": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select *, len(regexp_replace(role || text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) as escaped from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then len(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(escaped + len('<|im_start|><|im_sep|><|im_end|>')) as bigint) as formatted_chars
from e group by conv_id""",
}
