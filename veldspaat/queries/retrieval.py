"""Queries on the source gate and on retrieval."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.functions.text import joined, tokens
from veldspaat.operators.gate import audited, gate_status, usable
from veldspaat.operators.passages import block, contexts, listed, verdicts
from veldspaat.operators.ranking import first_per_key
from veldspaat.operators.retrieval import bm25, document_frequencies, length_statistics
from veldspaat.plans.joins import sized_join
from veldspaat.plans.shared import written
from veldspaat.plans.tasks import TASKS, planned
from veldspaat.queries import sqltext
from veldspaat.sources.corpora import FIELDS
from veldspaat.sources.tables import spread, table

CORPORA = ("kifid", "wetgeving", "polisvoorwaarden")


def _verified(corpus: str) -> Column:
    if corpus == "polisvoorwaarden":
        return F.lit(None).cast("boolean")
    return audited(F.col("bron_geverifieerd"), F.col("audit_bevinding")) if corpus == "kifid" else F.col("bron_geverifieerd")


def corpus(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The records of a corpus that pass the gate, each once."""
    rows = table(spark, folder, name).where(usable(_verified(name)))
    return first_per_key(spread(rows, "rij_id"), ["rij_id"], [F.col("rij_id")])


def _text(name: str) -> Column:
    return joined(*[F.col(c) for c in FIELDS[name]])


def gate_status_all(spark: SparkSession, folder: str) -> DataFrame:
    """Records, usable and refused ones of each corpus, with the first refused ids."""
    names = {"kifid": ["uitspraaknummer"], "wetgeving": ["artikel"], "polisvoorwaarden": ["clausule_id"]}
    parts = [gate_status(table(spark, folder, c), verified=_verified(c), names=[F.col(n) for n in names[c]]).withColumn("corpus", F.lit(c)) for c in CORPORA]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def gate_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rulings by their three-valued verification after the audit."""
    rows = table(spark, folder, "kifid").select(F.coalesce(_verified("kifid").cast("string"), F.lit("unknown")).alias("verified"), "bron_soort")
    return rows.groupBy("verified", "bron_soort").agg(F.count("*").alias("n"))


def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens and distinct tokens of every document."""
    t = spread(table(spark, folder, "documents"), "doc_id").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


def term_df(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency of every term."""
    return document_frequencies(spread(table(spark, folder, "documents"), "doc_id"), text=F.col("text"))


def doc_len_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number of documents and tokens, and the average length."""
    return length_statistics(spread(table(spark, folder, "documents"), "doc_id"), text=F.col("text")).withColumn("average", F.round("average", 6))


def term_weight_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences of every term by source."""
    texts = spread(table(spark, folder, "documents"), "doc_id").select("source", F.explode_outer(tokens(F.col("text"))).alias("term")).where("term is not null")
    return texts.groupBy("source", "term").agg(F.count("*").alias("n"))


def bm25_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The six best documents for each test item."""
    return bm25(spread(table(spark, folder, "documents"), "doc_id"), table(spark, folder, "toetsitems"), item="doc_id", text=F.col("text"), query="item_id", query_text=F.col("tekst"), k=6)


def _texts(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame:
    """(corpus, rij_id, text) of several corpora in one table."""
    return reduce(DataFrame.unionByName, [corpus(spark, folder, c).select(F.lit(c).alias("corpus"), "rij_id", _text(c).alias("text")) for c in names])


def _fanout(spark: SparkSession, folder: str, names: tuple[str, ...], k: int) -> DataFrame:
    items = table(spark, folder, "toetsitems")
    return bm25(_texts(spark, folder, names), items, item="rij_id", text=F.col("text"), query="item_id", query_text=joined(F.col("onderwerp"), F.col("tekst")), k=k, part="corpus")


def _hits(spark: SparkSession, folder: str, names: tuple[str, ...], k: int) -> dict[str, DataFrame]:
    """The records that the test items find in each corpus, whole: few rows, joined to the plain table, whose repeats are dropped after that."""
    hits = written(_fanout(spark, folder, names, k), "hits")
    found = {c: sized_join(table(spark, folder, c), hits.where(F.col("corpus") == c), ["rij_id"]) for c in names}
    return {c: rows.dropDuplicates(["item_id", "rank"]) for c, rows in found.items()}


def bm25_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """The four best records of every corpus for each test item."""
    return _fanout(spark, folder, CORPORA, 4)


def source_list(spark: SparkSession, folder: str) -> DataFrame:
    """The source list of each test item: three records of every corpus with label, title and fragment."""
    parts = [rows.select("item_id", "rank", *listed(c)) for c, rows in _hits(spark, folder, CORPORA, 3).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def context_block(spark: SparkSession, folder: str) -> DataFrame:
    """The context of each test item: titled sections with three passages of every corpus."""
    parts = [rows.select("item_id", "corpus", "rank", block(c).alias("passage")) for c, rows in _hits(spark, folder, CORPORA, 3).items()]
    return contexts(parts[0].unionByName(parts[1]).unionByName(parts[2]), query="item_id")


def precedent_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How the verdicts of the eight closest rulings are spread, for each test item."""
    return verdicts(_hits(spark, folder, ("kifid",), 8)["kifid"].select("item_id", "rank", "oordeel"), query="item_id", verdict="oordeel")


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """(req, functie, vraag): complaints as requests, each whole and under every task that searches its text; a task with
    a question of its own is asked once."""
    own = [t for t, (_, _, _, most) in TASKS.items() if most != 0]
    asked = first_per_key(table(spark, folder, "kifid").where("kern_klacht is not null"), ["rij_id"], [F.col("rij_id")])
    rows = asked.select("rij_id", F.col("kern_klacht").alias("vraag"), F.explode(F.array(*map(F.lit, own))).alias("functie"))
    rows = rows.select(F.concat_ws("-", "functie", "rij_id").alias("req"), "functie", "vraag")
    whole = [t for t in TASKS if t not in own]
    fixed = spark.createDataFrame(pa.table({"req": whole, "functie": whole}), "req string, functie string").withColumn("vraag", F.lit(None).cast("string"))
    return rows.unionByName(fixed)


def task_sources(spark: SparkSession, folder: str) -> DataFrame:
    """What every composed task finds for complaints, in one batch."""
    plan = planned(_requests(spark, folder), task="functie", text="vraag").withColumn("ask", F.unhex(F.sha2("question", 256)))
    asks = plan.groupBy("ask").agg(F.any_value("question").alias("question"), F.collect_set("corpus").alias("corpora"))  # what several tasks ask is searched once
    asks = asks.select("ask", "question", F.explode("corpora").alias("corpus"))
    hits = bm25(_texts(spark, folder, CORPORA), asks, item="rij_id", text=F.col("text"), query="ask", query_text=F.col("question"), k=8, part="corpus", asks_part=True)
    found = hits.join(plan.select("ask", "corpus", "req", "functie", "depth"), ["ask", "corpus"]).where("rank <= depth")
    return found.select("req", "corpus", "rij_id", "score", "rank", "functie")


def clause_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The six clauses closest to the exclusions of each product, to be laid side by side."""
    names = table(spark, folder, "polisvoorwaarden").where("product is not null").select("product").distinct()
    asked = names.select("product", F.concat("product", F.lit(" uitsluiting dekking eigen risico")).alias("vraag"))
    return bm25(corpus(spark, folder, "polisvoorwaarden"), asked, item="rij_id", text=_text("polisvoorwaarden"), query="product", query_text=F.col("vraag"), k=6)


_VERIFIED = {"kifid": "case when coalesce(audit_bevinding, '') <> '' then false else bron_geverifieerd end", "wetgeving": "bron_geverifieerd", "polisvoorwaarden": "cast(null as boolean)"}
_NAME = {"kifid": "uitspraaknummer", "wetgeving": "artikel", "polisvoorwaarden": "clausule_id"}


def _status_sql(c: str) -> str:
    ok = f"(({_VERIFIED[c]}) is distinct from false)"
    ids = f"select coalesce(string_agg(i, ',' order by i), '') from (select {_NAME[c]} as i from {c} where not {ok} and {_NAME[c]} <> '' order by 1 limit 10)"
    return f"select '{c}' as corpus, count(*) as records, count(*) filter ({ok}) as usable, count(*) filter (not {ok}) as refused, ({ids}) as refused_ids from {c}"


def _bm25_sql(texts: str, queries: str, k: int) -> str:
    """texts: (d, text), queries: (q, text)."""
    return f"""
with docs as (select d, {sqltext.tokens("text")} as t from ({texts})),
stats as (select greatest(count(*), 1)::double as n, sum(len(t)) / greatest(count(*), 1) as average from docs),
asked as (select q, term, count(*) as times from (select q, unnest({sqltext.tokens("text")}) as term from ({queries})) group by all),
postings as (select d, len, term, count(*) as tf from (select d, len(t) as len, unnest(t) as term from docs) where term in (select term from asked) group by all),
weights as (select q, a.term, times * ln(1 + (n - df + 0.5) / (df + 0.5)) as w
  from asked a join (select term, count(*) as df from postings group by term) f on a.term = f.term, stats),
scored as (select q, d, round(sum(w * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / average))), 6) as score
  from postings p join weights x on p.term = x.term, stats group by all)
select q, d, score, rank from (select *, (row_number() over (partition by q order by score desc, d))::int as rank from scored where score > 0) where rank <= {k}"""


def _corpus_sql(c: str) -> str:
    return f"(select * from {c} where ({_VERIFIED[c]}) is distinct from false qualify row_number() over (partition by rij_id) = 1)"


def _fanout_sql(c: str, k: int) -> str:
    texts = f"select rij_id as d, {sqltext.joined(*FIELDS[c])} as text from {_corpus_sql(c)}"
    return f"select q as item_id, d as rij_id, score, rank from ({_bm25_sql(texts, 'select item_id as q, ' + sqltext.joined('onderwerp', 'tekst') + ' as text from toetsitems', k)})"


_LISTED = {
    "wetgeving": "'wetgeving' as soort, coalesce(wet, 'None') || ' art. ' || coalesce(artikel, 'None') as label, titel, bron_url as url, left(coalesce(tekst, ''), 300) as fragment",
    "kifid": "'kifid' as soort, 'Kifid ' || coalesce(uitspraaknummer, 'None') as label, titel, bron_url as url, left(coalesce(samenvatting, ''), 300) as fragment",
    "polisvoorwaarden": "'polis' as soort, coalesce(product, 'None') || ' ' || coalesce(clausule_id, 'None') as label, kop as titel, bron_url as url, left(coalesce(tekst, ''), 300) as fragment",
}
_BLOCK = {
    "wetgeving": "'[' || coalesce(wet, 'None') || ' art. ' || coalesce(artikel, 'None') || '] ' || coalesce(titel, '') || chr(10) || left(coalesce(tekst, ''), 1200) || chr(10) || 'Bron: ' || coalesce(bron_url, 'None')",
    "kifid": "'[Kifid ' || coalesce(uitspraaknummer, 'None') || '] ' || coalesce(titel, '') || chr(10) || 'Oordeel: ' || coalesce(nullif(oordeel, ''), 'niet vastgesteld') || chr(10) || left(coalesce(nullif(samenvatting, ''), nullif(kern_klacht, ''), ''), 900) || chr(10) || 'Bron: ' || coalesce(bron_url, 'None')",
    "polisvoorwaarden": "'[' || coalesce(product, 'None') || ' ' || coalesce(clausule_id, 'None') || ' - ' || coalesce(type, 'None') || '] ' || coalesce(kop, '') || chr(10) || left(coalesce(tekst, ''), 900) || chr(10) || 'Bron: ' || coalesce(bron_url, 'None')",
}
_SECTION = {"wetgeving": (0, "WETGEVING"), "kifid": (1, "KIFID-UITSPRAKEN"), "polisvoorwaarden": (2, "POLISVOORWAARDEN")}


def _joined_sql(c: str, k: int, columns: str) -> str:
    return f"select item_id, rank, {columns} from {_corpus_sql(c)} r join ({_fanout_sql(c, k)}) h on r.rij_id = h.rij_id"


_CONTEXT = " union all ".join(
    f"select item_id, {p} as place, '=== {t} ===' || chr(10) || string_agg(passage, chr(10) || chr(10) order by rank) as s from ({_joined_sql(c, 3, _BLOCK[c] + ' as passage')}) group by item_id"
    for c, (p, t) in _SECTION.items()
)
_VERDICTS = f"""select item_id, sum(n)::bigint as n, string_agg(n || 'x ' || v, ', ' order by n desc, r) as summary from (
  select item_id, v, count(*) as n, min(rank) as r from ({_joined_sql("kifid", 8, "lower(coalesce(nullif(oordeel, ''), 'onbekend')) as v")}) group by item_id, v) group by item_id"""



def _task_sql(c: str) -> str:
    cases = []
    for t, (corpora, depth, words, most) in TASKS.items():
        if c in corpora:
            own = "v" if most is None else f"left(v, {most})"
            asked = f"select '{t}-' || rij_id as q, '{t}' as functie, {depth} as depth, trim(concat_ws(' ', {own}, '{words}')) as text from {_ASKED}"
            cases.append(asked if most != 0 else f"select '{t}' as q, '{t}' as functie, {depth} as depth, '{words}' as text")
    mine = " union all ".join(cases)
    hits = _bm25_sql(f"select rij_id as d, {sqltext.joined(*FIELDS[c])} as text from {_corpus_sql(c)}", f"select q, text from ({mine})", 8)
    return f"select h.q as req, d as rij_id, score, rank, functie, '{c}' as corpus from ({hits}) h join ({mine}) m on h.q = m.q where rank <= depth"


_ASKED = "(select rij_id, kern_klacht as v from kifid where kern_klacht is not null qualify row_number() over (partition by rij_id) = 1)"
QUERIES = {
    f.__name__: f
    for f in (gate_rows, tokenize_counts, term_df, doc_len_stats, term_weight_by_source, bm25_documents, bm25_fanout, source_list, context_block, precedent_summary, clause_compare, task_sources)
} | {"gate_status": gate_status_all}
SQL = {
    "gate_status": " union all ".join(map(_status_sql, CORPORA)),
    "gate_rows": f"select coalesce(cast({_VERIFIED['kifid']} as varchar), 'unknown') as verified, bron_soort, count(*) as n from kifid group by all",
    "tokenize_counts": f"select doc_id, len(t)::int as n_tokens, len(list_distinct(t))::int as n_terms from (select doc_id, {sqltext.tokens('text')} as t from documents)",
    "term_df": f"select term, count(*) as df from (select unnest(list_distinct({sqltext.tokens('text')})) as term from documents) group by term",
    "doc_len_stats": f"select greatest(count(*), 1) as n_docs, coalesce(sum(len(t)), 0)::bigint as n_tokens, round(coalesce(sum(len(t)), 0) / greatest(count(*), 1), 6) as average from (select {sqltext.tokens('text')} as t from documents)",
    "term_weight_by_source": f"select source, term, count(*) as n from (select source, unnest({sqltext.tokens('text')}) as term from documents) group by all",
    "bm25_documents": f"select q as item_id, d as doc_id, score, rank from ({_bm25_sql('select doc_id as d, text from documents', 'select item_id as q, tekst as text from toetsitems', 6)})",
    "bm25_fanout": " union all ".join(f"select *, '{c}' as corpus from ({_fanout_sql(c, 4)})" for c in CORPORA),
    "source_list": " union all ".join(_joined_sql(c, 3, _LISTED[c]) for c in CORPORA),
    "context_block": f"select item_id, string_agg(s, chr(10) || chr(10) order by place) as context from ({_CONTEXT}) group by item_id",
    "precedent_summary": _VERDICTS,
    "task_sources": " union all ".join(map(_task_sql, CORPORA)),
    "clause_compare": "select q as product, d as rij_id, score, rank from ("
    + _bm25_sql(f"select rij_id as d, {sqltext.joined(*FIELDS['polisvoorwaarden'])} as text from {_corpus_sql('polisvoorwaarden')}", "select distinct product as q, product || ' uitsluiting dekking eigen risico' as text from polisvoorwaarden where product is not null", 6)
    + ")",
}
