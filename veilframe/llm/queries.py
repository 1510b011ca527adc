"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import licenses, merkle, pii, runs, sharding
from veilframe.llm.exact_dedup import duplicate_groups
from veilframe.llm.mixing import mix
from veilframe.llm.packing import pack
from veilframe.llm.repetition import repetition_rules
from veilframe.llm.simhash import near_duplicates
from veilframe.llm.substrings import remove_repeats
from veilframe.llm.token_counts import count_tokens
from veilframe.llm.warc import captures, read_records, resolved, write_pages
from veilframe.plans.registry import Query
from veilframe.session import table, work_path

QUERIES: dict[str, Query] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = Query(fn, oracle)
        return fn

    return add


@_query("op1_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query("op3_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SUBSTRINGS_SQL = rf"""
with w as (select doc_id, {_WORDS} as ws from documents),
starts as (select doc_id, unnest(generate_series(1, len(ws) - 34)) as i, ws from w where len(ws) >= 35),
windows as (select doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) as win from starts),
again as (select win from windows group by win having count(*) > 1),
hits as (select doc_id, i from windows semi join again using (win)),
gone as (select distinct doc_id, unnest(generate_series(i, i + 34)) as i from hits),
each as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
kept as (
  select e.doc_id, string_agg(e.word, ' ' order by e.i) as txt from each e
  anti join gone g on e.doc_id = g.doc_id and e.i = g.i group by e.doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(lost.n, 0) as bigint) as n_removed,
  sha256(coalesce(kept.txt, '')) as kept_sha256
from w left join kept using (doc_id) left join lost using (doc_id)
"""


@_query("op8_substring_dedup", SUBSTRINGS_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op10_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", repetition_rules("text").alias("q")).select("doc_id", "q.*")


@_query("op2_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = pack(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha256(b) as h from p),
g as (select h, min(page_id) as keep from d where n >= 100 group by h)
select d.page_id, d.n as payload_bytes, d.h as payload_digest,
  case when g.keep is null or g.keep = d.page_id then 'response' else 'revisit' end as record_type,
  case when g.keep <> d.page_id then g.keep end as refers_to
from d left join g on d.h = g.h
"""


@_query("op4_warc", WARC_SQL)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "archive")
    write_pages(table(spark, sf_dir, "pages"), path)
    return resolved(captures(read_records(spark, path), with_payload=False))


EXACT_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents),
r as (select *, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size
  from d window w as (partition by h order by n desc, doc_id))
select doc_id, keep_id, group_size, keep_id = doc_id as kept, h as text_sha256 from r
"""


@_query("op6_exact_dedup", EXACT_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


#: Sources are grouped into domains for the budget tree: the crawl, and everything else.
MIX_WEIGHTS = {
    "domain": {"crawl": 0.3, "curated": 0.7},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "source": {"*": 1.0},
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 42


def mix_levels() -> dict:
    return {
        "domain": F.when(F.col("source") == "src0", "crawl").otherwise("curated"),
        "lang": F.col("lang"),
        "source": F.col("source"),
    }


@_query("op9_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, mix_levels(), MIX_SHARE, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED)
    return mixed.select(F.col("id_0").alias("doc_id"), "domain", "lang", "source", "n_tokens", "n_copies", F.col("budget").alias("leaf_budget"))


@_query("op5_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans")
    )


@_query("op7_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


#: Columns of a leaf of the manifest, and the children of a node.
_LEAF = ("doc_id", "source", "lang", "n_chars", "text")
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _crc32_sql(of: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, byte by byte over a table of 256 remainders."""
    read = f"list_transform(regexp_extract_all(hex(encode({of})), '..'), lambda h: cast('0x' || h as bigint))"
    step = "xor(acc >> 8, t[cast(xor(acc, b) & 255 as bigint) + 1])"
    return f"xor(list_reduce({read}, lambda acc, b: {step}, 4294967295), 4294967295)"


_CRC_TABLE = """crc_bits as (select i as n, i as v, 0 as k from range(256) r(i)
  union all select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from crc_bits where k < 8),
crc_table as (select list(v order by n) as t from crc_bits where k = 8)"""


def _level_sql(table: str, levels: int, key: str) -> str:
    """Levels above a table (``key``, k, n, h): each with its runs; a tree of one node keeps it."""
    out = []
    for i in range(levels):
        below = table if i == 0 else f"{table}{i}"
        out.append(f"""{below}r as (select {key}, k // 16 as k, any_value(n) as n, list(h order by k) as l from {below} group by {key}, k // 16),
{table}{i + 1} as (select {key}, k, (n + 15) // 16 as n, case when n = 1 then l[1] else sha256(array_to_string(l, '')) end as h from {below}r)""")
    return ",\n".join(out)


def _steps_sql(table: str, levels: int, key: str, unit: str) -> tuple[list[str], list[str], list[str]]:
    """Joins of a leaf's runs, and the siblings left and right of it on each level (null where a tree has one node)."""
    joins, left, right = [], [], []
    for i in range(levels):
        below, name, own = (table if i == 0 else f"{table}{i}"), f"{table}r_{i}", f"({unit} // {16**i})"
        joins.append(f"join {below}r {name} on {name}.{key} = {'d.s' if key == 's' else '0'} and {name}.k = {own} // 16")
        left.append(f"case when {name}.n > 1 then array_to_string({name}.l[1:{own} % 16], '') end")
        right.append(f"case when {name}.n > 1 then array_to_string({name}.l[{own} % 16 + 2:], '') end")
    return joins, left, right


def _manifest_sql(levels: int = 5, upper: int = 2) -> str:
    """The manifest unrolled: up to 16^levels rows of a source and 16^upper sources."""
    leaf = lambda text: "sha256(concat(" + ", ".join(
        f"case when {c} is null then '-' else concat(octet_length(encode(cast({v} as varchar))), ':', cast({v} as varchar)) end"
        for c, v in ((c, text if c == "text" else c) for c in _LEAF)) + "))"
    joins, left, right = _steps_sql("a", levels, "s", "d.k")
    more, up_left, up_right = _steps_sql("b", upper, "z", "(d.s - 1)")
    left, right = left + up_left, right + up_right
    proof = ", ".join(f"{lt}, {rt}" for lt, rt in zip(left, right, strict=True))
    folds = ["f0 as (select *, claim as f from steps)"]
    for i in range(levels + upper):
        folds.append(f"f{i + 1} as (select * exclude (f), case when l{i} is null then f else sha256(concat(l{i}, f, r{i})) end as f from f{i})")
    return rf"""
with recursive {_CRC_TABLE},
docs as (select doc_id, source, {leaf("text")} as leaf, {leaf("translate(text, '" + _LETTERS[0] + "', '" + _LETTERS[1] + "')")} as low,
  {_crc32_sql("cast(doc_id as varchar)")} % 5 = 0 as bad from documents, crc_table),
d as (select *, dense_rank() over (order by source nulls first) as s, row_number() over (partition by source order by doc_id) - 1 as k from docs),
a as (select s, k, count(*) over (partition by s) as n, leaf as h from d),
{_level_sql("a", levels, "s")},
b as (select 0 as z, s - 1 as k, count(*) over () as n, h from a{levels}),
{_level_sql("b", upper, "z")},
steps as (select d.doc_id, d.leaf, case when d.bad then d.low else d.leaf end as claim, t.h as subroot, r.h as root,
  sha256(concat({proof})) as proof_sha256, {", ".join(f"{v} as l{i}, {w} as r{i}" for i, (v, w) in enumerate(zip(left, right, strict=True)))}
  from d join a{levels} t on t.s = d.s cross join b{upper} r {" ".join(joins)} {" ".join(more)}),
{", ".join(folds)}
select doc_id, leaf, subroot, root, proof_sha256, f as folded_root, f = root as verified from f{levels + upper}
"""


@_query("op11_merkle_manifest", _manifest_sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.when(tampered, F.translate("text", *_LETTERS)).otherwise(F.col("text"))
    found = merkle.verified(merkle.build(docs, "doc_id", "source", _LEAF, {"text": lower}))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SHARD_SQL = f"""
with recursive {_CRC_TABLE},
d as (select doc_id, source, octet_length(encode(coalesce(text, ''))) + {sharding.OVERHEAD} as size, {_crc32_sql("coalesce(text, '')")} as text_crc32,
  cast('0x' || md5('{sharding.SEED}:' || doc_id)[1:15] as bigint) as draw from documents, crc_table),
r as (select *, row_number() over (partition by source order by draw, doc_id) as k, count(*) over (partition by source) as n,
  dense_rank() over (order by source nulls first) as s from d),
p as (select *, row_number() over (order by
  (cast(k - 1 as double) + cast(cast('0x' || md5('{sharding.SEED}:' || coalesce(source, ''))[1:15] as bigint) as double) / {float(1 << 60)}) / cast(n as double), s) - 1 as place, count(*) over () as total from r),
c as (select *, place * {sharding.SHARDS} // total as shard from p)
select doc_id, size, text_crc32, 'rows' as law, cast(shard as integer) as shard,
  place - (shard * total + {sharding.SHARDS - 1}) // {sharding.SHARDS} as slot, cast(null as integer) as grown_shard from c
"""


@_query("op12_sharding", SHARD_SQL)
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.interleave(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten has its words from place ``a`` on replaced by a repetition of the first ``p`` of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    marked = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.expr("h div 10"), F.size("words")
    marked = marked.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.expr("1 + (size(words) - a) div (3 + (h div 10) % 8)"))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return marked.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@_query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(planted_runs(table(spark, sf_dir, "documents")), "found").select("doc_id", "found.*")
    longest = runs.longest_run(F.col("runs"))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("top"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(runs.run_list(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
