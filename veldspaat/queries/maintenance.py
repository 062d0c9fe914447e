"""Queries on choosing, replacing, numbering and validating records, and on ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.functions.text import ITEM, after_contents, between, cleaned, clipped, collapse, dates, letters, normal, rejoined, tags, ticks_date, without_tags
from veldspaat.operators.gate import redirect_verified
from veldspaat.operators.profiles import band_statistics, runs, steepest, trailing_and_following
from veldspaat.operators.quality import TYPES, containment, mixed_hashes, report, row_violations
from veldspaat.operators.ranking import capped, first_per_key, label, numbered, seeded, top_per_group, viewport, words_in
from veldspaat.operators.versions import version_on
from veldspaat.queries.sqltext import clean as clean_sql
from veldspaat.queries.sqltext import collapse as squash
from veldspaat.sources.tables import table

DAY = "2020-01-01"
NEWER = "1997-06-30"
WORDS = ["polis", "premie", "gids", "bank", "markt", "wijzer"]


def _rulings(spark: SparkSession, folder: str) -> DataFrame:
    return first_per_key(table(spark, folder, "kifid"), ["rij_id"], [F.col("rij_id")])


def topk_per_theme(spark: SparkSession, folder: str) -> DataFrame:
    """The four rulings of each theme that say most: with complaint, verdict, reasons, known force, then the latest."""
    rows = _rulings(spark, folder).where("kern_klacht is not null")
    order = [F.desc(F.col(c).isNotNull()) for c in ("oordeel", "kernoverweging", "bindend")] + [F.desc(F.coalesce("datum", F.lit(""))), F.asc("rij_id")]
    return top_per_group(rows, ["thema"], order, 4).select("thema", "rank", "rij_id", "uitspraaknummer")


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of every ruling number; the theme is that of the first find."""
    return first_per_key(table(spark, folder, "kifid").where("uitspraaknummer is not null"), ["uitspraaknummer"], [F.asc("rij_id")]).select("uitspraaknummer", "rij_id", "thema")


def result_order(spark: SparkSession, folder: str) -> DataFrame:
    """All rulings in order, the latest first, by date and number."""
    rows = _rulings(spark, folder).orderBy(F.desc(F.coalesce("datum", F.lit(""))), F.desc(F.coalesce("uitspraaknummer", F.lit(""))), F.asc("rij_id"))
    return rows.select("rij_id", "uitspraaknummer", "datum")


def law_version(spark: SparkSession, folder: str) -> DataFrame:
    """The article texts that held on a day."""
    rows = table(spark, folder, "wetgeving").select("bwb_id", "artikel", "geldig_op", "toestand_einddatum", "rij_id", "tekst")
    found = version_on(rows, key=["bwb_id", "artikel"], day=F.lit(DAY).cast("date"), start="geldig_op", end="toestand_einddatum", order=["rij_id"])
    return found.select("bwb_id", "artikel", F.date_format("geldig_op", "yyyy-MM-dd").alias("geldig_op"), "rij_id", F.coalesce(F.length("tekst"), F.lit(-1)).alias("n_chars"))


def upsert_lastwins(spark: SparkSession, folder: str) -> DataFrame:
    """All deliveries as one state: a clause of a later delivery replaces that of every earlier one."""
    row = F.struct("opgehaald_op", "ingelezen_op", F.coalesce("tekst", F.lit("")).alias("tekst"))
    whole = table(spark, folder, "polis_levering").groupBy("product", "clausule_id").agg(F.max(row).alias("_row")).select("_row.opgehaald_op", "_row.tekst")
    return whole.groupBy(F.date_format("opgehaald_op", "yyyy-MM-dd").alias("opgehaald_op")).agg(F.count("*").alias("clausules"), F.sum(F.length("tekst")).alias("n_chars"))


def upsert_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Orders taken over from the list up to a day unless the list after it has the customer."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderdate") > F.lit(NEWER).cast("date")).alias("newer"))
    newer = orders.where("newer").select("o_custkey").distinct()
    return orders.where("not newer").join(newer, "o_custkey", "left_anti").select("o_orderkey", "o_custkey", "o_orderstatus")


def cap_per_host(spark: SparkSession, folder: str) -> DataFrame:
    """At most three documents of each host; documents of no source are exempt."""
    rows = table(spark, folder, "documents").select("doc_id", "host", "source")
    return capped(rows, ["host"], [F.asc("doc_id")], 3, F.col("source").isNull())


def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred documents drawn by seed, the same on any cluster."""
    return table(spark, folder, "documents").select("doc_id", seeded(F.col("doc_id"), 20260913).alias("draw")).orderBy("draw", "doc_id").limit(100)


def blind_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Rulings in a seeded order, each with its place and letter label."""
    rows = _rulings(spark, folder).select("rij_id", seeded(F.col("rij_id"), 7).alias("draw"))
    return numbered(rows, ["draw", "rij_id"]).select("rij_id", "n", label(F.col("n")).alias("label"))


def leak_words(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose address gives away one of some words."""
    return table(spark, folder, "documents").select("doc_id", F.array_join(words_in(F.col("url"), WORDS), ",").alias("words")).where("words <> ''")


def viewport_class(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the device their address names."""
    return table(spark, folder, "documents").groupBy(viewport(F.coalesce("url", F.lit(""))).alias("viewport")).agg(F.count("*").alias("n"))


def redirect_state(spark: SparkSession, folder: str) -> DataFrame:
    """Articles by whether their check address leads to their anchor: yes, no or not reached."""
    rows = table(spark, folder, "wetgeving")
    state = redirect_verified(F.when(F.col("bron_verificatie_url").isNotNull(), 302), F.col("bron_url"), F.concat(F.lit("art_"), F.replace("artikel", F.lit(":"), F.lit("_"))))
    return rows.groupBy(F.coalesce(state.cast("string"), F.lit("unknown")).alias("verified")).agg(F.count("*").alias("n"))


def qc_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Every violation in the policy clauses: missing, not allowed, blank."""
    required = ["product", "verzekeraar_of_bron", "document", "clausule_id", "kop", "tekst", "type", "bron_url", "bron_pdf_sha256", "opgehaald_op"]
    return row_violations(table(spark, folder, "polisvoorwaarden"), item="rij_id", required=required, allowed={"type": TYPES}, not_blank=["kop", "tekst"])


def qc_report(spark: SparkSession, folder: str) -> DataFrame:
    """Violations counted by rule and column, sources with more than one digest included."""
    rows = table(spark, folder, "polisvoorwaarden")
    mixed = mixed_hashes(rows, source="bron_url", digest=F.lower("bron_pdf_sha256")).select(F.lit(None).cast("long").alias("rij_id"), F.lit("mixed").alias("rule"), F.lit("bron_pdf_sha256").alias("column"))
    return report(qc_violations(spark, folder), mixed)


def qc_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Exact numbers of addresses, products and insurers in each delivery."""
    rows = table(spark, folder, "polis_levering").groupBy(F.date_format("opgehaald_op", "yyyy-MM-dd").alias("opgehaald_op"))
    return rows.agg(F.count_distinct("bron_url").alias("urls"), F.count_distinct("product").alias("products"), F.count_distinct("verzekeraar_of_bron").alias("insurers"))


def verbatim_check(spark: SparkSession, folder: str) -> DataFrame:
    """Current clauses against all deliveries of the same clause: is the wording, letter for letter, in one of them?"""
    now = table(spark, folder, "polisvoorwaarden").where("tekst <> ''").select("rij_id", "product", collapse(F.col("clausule_id")).alias("clausule_id"), "tekst").distinct()
    then = table(spark, folder, "polis_levering").where("tekst is not null").select("product", collapse(F.col("clausule_id")).alias("clausule_id"), F.col("tekst").alias("geleverd")).distinct()
    return containment(now, then, on=["product", "clausule_id"], part="tekst", whole="geleverd").groupBy("rij_id").agg(F.bool_or("verbatim").alias("verbatim"), F.count("*").alias("n_versions"))


def text_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are exact copies: digest of the text and how many have it."""
    return table(spark, folder, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def ws_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses whose white space changes when collapsed, with both lengths."""
    rows = table(spark, folder, "polisvoorwaarden").select("rij_id", "tekst", normal(F.col("tekst")).alias("n")).distinct()
    return rows.where("n <> tekst").select("rij_id", F.length("tekst").alias("before"), F.length("n").alias("after"))


def letters_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Headings that are the same but for case, spaces and punctuation."""
    rows = table(spark, folder, "polisvoorwaarden").where("kop is not null")
    return rows.groupBy(letters(F.col("kop")).alias("letters")).agg(F.count_distinct("kop").alias("spellings"), F.count("*").alias("n")).where("spellings > 1")


def clip_sentence(spark: SparkSession, folder: str) -> DataFrame:
    """Complaints clipped to 400 characters at a sentence or a word."""
    return table(spark, folder, "kifid").where("kern_klacht is not null").select("rij_id", clipped(F.col("kern_klacht"), 400).alias("clipped")).distinct()


def tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often every word of a ruling's tags is used, read from a comma list."""
    rows = table(spark, folder, "kifid").select(tags(F.array_join("kifid_onderwerp_tags", ", ")).alias("tags"))
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tagless(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with tags in them, and their length without."""
    rows = table(spark, folder, "documents").where(F.col("text").rlike("<[^>]+>"))
    return rows.select("doc_id", F.coalesce(F.length(without_tags(F.col("text"))), F.lit(0)).alias("n_chars"))


def dates_found(spark: SparkSession, folder: str) -> DataFrame:
    """Dates that complaints mention, by year and month."""
    found = table(spark, folder, "kifid").select(F.explode(dates(F.col("kern_klacht"))).alias("d")).where("d is not null")
    return found.groupBy(F.year("d").alias("year"), F.month("d").alias("month")).agg(F.count("*").alias("n"))


def ticks_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates carried through a count of 100 ns since year 1 and back."""
    ticks = (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 62_135_596_800) * 10_000_000
    return table(spark, folder, "orders").groupBy(F.date_format(ticks_date(ticks), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses with page furniture and hyphenation removed and wrapped lines joined, by length before and after."""
    rows = table(spark, folder, "polisvoorwaarden").where("tekst is not null").select("rij_id", "tekst").distinct()
    return rows.select("rij_id", F.length("tekst").alias("before"), F.length(rejoined(cleaned(F.col("tekst")))).alias("after"))


def toc_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that begin with a table of contents, and what is left behind it."""
    rows = table(spark, folder, "documents").select("doc_id", "text", after_contents(F.col("text")).alias("body"))
    return rows.where("body is null or body <> text").select("doc_id", F.length("text").alias("before"), F.coalesce(F.length("body"), F.lit(-1)).alias("after"))


def marker_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The part of each article between its first and second member numbers, or why it can't be cut."""
    cut = between(F.col("tekst"), F.lit("1. "), F.lit("2. "))
    rows = table(spark, folder, "wetgeving").where("tekst is not null").select("rij_id", "tekst").distinct().select("rij_id", cut.alias("c"))
    return rows.select("rij_id", F.coalesce(F.length("c.cut"), F.lit(-1)).alias("n_chars"), F.col("c.error").alias("error"))


def runs_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Longest run of equal event types of each user and type."""
    found = runs(table(spark, folder, "events"), group=["user_id"], order=["event_id"], state=F.col("event_type"))
    return found.groupBy("user_id", F.col("state").alias("event_type")).agg(F.max("n").alias("longest"), F.count("*").alias("n_runs"))


def trailing_means(spark: SparkSession, folder: str) -> DataFrame:
    """Events after which the mean to come is over twice the mean of the 80 before, in cents."""
    rows = table(spark, folder, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    found = trailing_and_following(rows, group=["user_id"], order=["event_id"], value="value", back=80)
    return found.where("after > 2 * before").select("event_id", F.floor("before").alias("before"), F.floor("after").alias("after"))


def steepest_step(spark: SparkSession, folder: str) -> DataFrame:
    """Where each user's value changes most from one event to the next."""
    return steepest(table(spark, folder, "events"), group=["user_id"], order=["event_id"], value="value").select("user_id", F.round("step", 4).alias("step"), "at")


def band_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, deviation, share of calm values and lower quartile of each event type."""
    found = band_statistics(table(spark, folder, "events"), group=["event_type"], value="value", calm=10.0)
    return found.select("event_type", *[F.round(c, 4).alias(c) for c in ("mean", "spread", "calm_share", "quartile")])


def json_props(spark: SparkSession, folder: str) -> DataFrame:
    """Events by the number in their JSON properties."""
    rows = table(spark, folder, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("n"))


_ONE = "qualify row_number() over (partition by rij_id) = 1"
_REQUIRED = ("product", "verzekeraar_of_bron", "document", "clausule_id", "kop", "tekst", "type", "bron_url", "bron_pdf_sha256", "opgehaald_op")
_SPACES = "[\\x{09}-\\x{0D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_VIOLATIONS = " union all ".join(
    [f"select rij_id, 'missing' as rule, '{c}' as \"column\" from polisvoorwaarden where {c} is null" for c in _REQUIRED]
    + [f"select rij_id, 'not allowed', 'type' from polisvoorwaarden where type not in ({', '.join(repr(t) for t in TYPES)})"]
    + [f"select rij_id, 'blank', '{c}' from polisvoorwaarden where regexp_replace({c}, '{_SPACES}', '', 'g') = ''" for c in ("kop", "tekst")]
)
_DATE = r"\b(\d{1,2}) (januari|februari|maart|april|mei|juni|juli|augustus|september|oktober|november|december) (\d{4})\b"
_LETTERS = "lower(regexp_replace({}, '[^0-9a-zA-Zà-öø-ÿ€%]', '', 'g'))"

QUERIES = {
    f.__name__: f
    for f in (
        topk_per_theme, dedupe_first, result_order, law_version, upsert_lastwins, upsert_anti, cap_per_host, seeded_sample, blind_labels, leak_words, viewport_class, redirect_state,
        qc_violations, qc_report, qc_distinct, verbatim_check, text_hash, ws_norm, letters_norm, clip_sentence, tag_counts, tagless, dates_found, ticks_dates, clean_lines, toc_cut, marker_cut,
        runs_islands, trailing_means, steepest_step, band_stats, json_props,
    )
}
SQL = {
    "topk_per_theme": f"""select thema, rank::int as rank, rij_id, uitspraaknummer from (select *, row_number() over (partition by thema order by oordeel is not null desc, kernoverweging is not null desc,
  bindend is not null desc, coalesce(datum, '') desc, rij_id) as rank from (select * from kifid {_ONE}) where kern_klacht is not null) where rank <= 4""",
    "dedupe_first": "select uitspraaknummer, rij_id, thema from kifid where uitspraaknummer is not null qualify row_number() over (partition by uitspraaknummer order by rij_id) = 1",
    "result_order": f"select rij_id, uitspraaknummer, datum from (select * from kifid {_ONE}) order by coalesce(datum, '') desc, coalesce(uitspraaknummer, '') desc, rij_id",
    "law_version": f"""select bwb_id, artikel, strftime(geldig_op, '%Y-%m-%d') as geldig_op, rij_id, coalesce(length(tekst), -1)::int as n_chars from wetgeving
  where geldig_op <= date '{DAY}' and coalesce(toestand_einddatum, date '9999-12-31') >= date '{DAY}'
  qualify row_number() over (partition by bwb_id, artikel order by geldig_op desc, coalesce(toestand_einddatum, date '9999-12-31') desc, rij_id desc) = 1""",
    "upsert_lastwins": """with latest as (select product, clausule_id, opgehaald_op, coalesce(tekst, '') as tekst from polis_levering
  qualify row_number() over (partition by product, clausule_id order by opgehaald_op desc nulls last, ingelezen_op desc nulls last, coalesce(tekst, '') desc) = 1)
select strftime(opgehaald_op, '%Y-%m-%d') as opgehaald_op, count(*) as clausules, sum(length(tekst))::bigint as n_chars from latest group by 1""",
    "upsert_anti": f"select o_orderkey, o_custkey, o_orderstatus from orders where o_orderdate <= date '{NEWER}' and o_custkey not in (select o_custkey from orders where o_orderdate > date '{NEWER}')",
    "cap_per_host": """select doc_id, host, source from (select * from documents where source is not null qualify row_number() over (partition by host order by doc_id) <= 3)
  union all select doc_id, host, source from documents where source is null""",
    "seeded_sample": "select doc_id, md5('20260913:' || doc_id) as draw from documents order by draw, doc_id limit 100",
    "blind_labels": f"""select rij_id, n, case when n <= 26 then chr(64 + n::int) when n <= 702 then chr(65 + ((n - 27) // 26)::int) || chr(65 + ((n - 27) % 26)::int)
  when n <= 18278 then chr(65 + ((n - 703) // 676)::int) || chr(65 + ((n - 703) // 26 % 26)::int) || chr(65 + ((n - 703) % 26)::int)
  else chr(65 + ((n - 18279) // 17576)::int) || chr(65 + ((n - 18279) // 676 % 26)::int) || chr(65 + ((n - 18279) // 26 % 26)::int) || chr(65 + ((n - 18279) % 26)::int) end as label
  from (select rij_id, row_number() over (order by md5('7:' || rij_id), rij_id) as n from (select * from kifid {_ONE}))""",
    "leak_words": f"select doc_id, words from (select doc_id, array_to_string(list_filter({WORDS!r}, lambda w: contains(lower(url), w)), ',') as words from documents) where words <> ''",
    "viewport_class": """select case when contains(n, 'mobile') or regexp_matches(n, '[_-]390(?:[x_.-]|$)') then 'mobile'
  when contains(n, 'desktop') or regexp_matches(n, '[_-]1440(?:[x_.-]|$)') then 'desktop' else 'onbekend' end as viewport, count(*) as n from (select lower(coalesce(url, '')) as n from documents) group by 1""",
    "redirect_state": """select case when bron_verificatie_url is null then 'unknown' when coalesce(ends_with(bron_url, '#art_' || replace(artikel, ':', '_')), false) then 'true' else 'false' end as verified,
  count(*) as n from wetgeving group by 1""",
    "qc_violations": _VIOLATIONS,
    "qc_report": f"""select rule, "column", count(*) as n from ({_VIOLATIONS} union all
  select null, 'mixed', 'bron_pdf_sha256' from (select bron_url from polisvoorwaarden group by 1 having count(distinct lower(bron_pdf_sha256)) > 1)) group by all""",
    "qc_distinct": "select strftime(opgehaald_op, '%Y-%m-%d') as opgehaald_op, count(distinct bron_url) as urls, count(distinct product) as products, count(distinct verzekeraar_of_bron) as insurers from polis_levering group by 1",
    "verbatim_check": f"""select rij_id, bool_or(contains({_LETTERS.format("geleverd")}, {_LETTERS.format("tekst")})) as verbatim, count(*) as n_versions
  from (select distinct rij_id, product, {squash("clausule_id")} as clausule_id, tekst from polisvoorwaarden where tekst <> '')
  join (select distinct product, {squash("clausule_id")} as clausule_id, tekst as geleverd from polis_levering where tekst is not null) using (product, clausule_id) group by rij_id""",
    "text_hash": "select sha256(text) as digest, count(*) as n, min(doc_id) as first from documents where text is not null group by 1 having count(*) > 1",
    "ws_norm": f"select distinct rij_id, length(tekst)::int as before, length({squash('tekst')})::int as after from polisvoorwaarden where tekst <> '' and {squash('tekst')} <> tekst",
    "letters_norm": f"select {_LETTERS.format('kop')} as letters, count(distinct kop) as spellings, count(*) as n from polisvoorwaarden where kop is not null group by 1 having count(distinct kop) > 1",
    "clip_sentence": """with t as (select distinct rij_id, kern_klacht as t, left(kern_klacht, 400) as c from kifid where kern_klacht is not null),
p as (select *, length(c) - 1 - nullif(strpos(reverse(c), ' .'), 0) as dot, length(c) - 1 - nullif(strpos(reverse(c), ' !'), 0) as bang,
  length(c) - 1 - nullif(strpos(reverse(c), ' ?'), 0) as ask, length(c) - nullif(strpos(reverse(c), ' '), 0) as space from t)
select rij_id, case when length(t) <= 400 then t when dot > 160 then left(c, dot + 1) when bang > 160 then left(c, bang + 1) when ask > 160 then left(c, ask + 1)
  when space is not null then rtrim(left(c, space)) || ' [...]' else c || ' [...]' end as clipped from p""",
    "tagless": "select doc_id, length(t)::int as n_chars from (select doc_id, "
    + squash("replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&euro;', '€'), '&amp;', '&')")
    + " as t from documents where regexp_matches(text, '<[^>]+>'))",
    "tag_counts": "select tag, count(*) as n from (select unnest(list_filter(list_transform(string_split(array_to_string(kifid_onderwerp_tags, ', '), ','), lambda x: trim(x)), lambda x: x <> '')) as tag from kifid) group by tag",
    "dates_found": f"""select year(d)::int as year, month(d)::int as month, count(*) as n from (
  select try_cast(y || '-' || lpad(list_position(['januari', 'februari', 'maart', 'april', 'mei', 'juni', 'juli', 'augustus', 'september', 'oktober', 'november', 'december'], m)::varchar, 2, '0') || '-' || lpad(dd, 2, '0') as date) as d
  from (select unnest(regexp_extract_all(kern_klacht, '{_DATE}', 1)) as dd, unnest(regexp_extract_all(kern_klacht, '{_DATE}', 2)) as m, unnest(regexp_extract_all(kern_klacht, '{_DATE}', 3)) as y from kifid))
  where d is not null group by all""",
    "ticks_dates": "select strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders group by 1",
    "marker_cut": f"""select rij_id, (case when error is null then length(trim(substr(t, strpos(t, '1. '), strpos(t, '2. ') - strpos(t, '1. ')))) else -1 end)::int as n_chars, error from (
  select rij_id, t, case when (length(t) - length(replace(t, '1.', ''))) // 2 <> 1 then 'start ' || (length(t) - length(replace(t, '1.', ''))) // 2 || 'x'
    when (length(t) - length(replace(t, '2.', ''))) // 2 <> 1 then 'end ' || (length(t) - length(replace(t, '2.', ''))) // 2 || 'x'
    when strpos(t, '2.') <= strpos(t, '1.') then 'end before start' end as error
  from (select distinct rij_id, {squash("tekst")} as t from wetgeving where tekst is not null))""",
    "clean_lines": f"""select rij_id, length(tekst)::int as before, length(array_to_string(list_transform(lines, lambda r, i: case when i = 1 then '' when regexp_matches(r, '{ITEM}') then chr(10) else ' ' end || r), ''))::int as after
  from (select rij_id, tekst, list_filter(list_transform(string_split({clean_sql("tekst")}, chr(10)), lambda r: trim(regexp_replace(r, '[ \t\r]+', ' ', 'g'))), lambda r: r <> '') as lines
    from (select distinct rij_id, tekst from polisvoorwaarden where tekst is not null))""",
    "toc_cut": r"""with t as (select doc_id, text, string_split(text, chr(10)) as lines from documents where text is not null),
l as (select *, list_max(list_transform(range(1, least(len(lines), 220) + 1), lambda i: case when length(trim(lines[i])) > 15 and regexp_matches(trim(lines[i]), '^\S.*\s\d{1,3}\s*$') then i end)) as last from t),
b as (select *, case when last is null then text else array_to_string(lines[last + 1:], chr(10)) end as body from l)
select doc_id, length(text)::int as before, (case when length(body) >= 0.5 * length(text) then length(body) else -1 end)::int as after from b
where length(body) < 0.5 * length(text) or body <> text""",
    "runs_islands": """select user_id, event_type, max(n) as longest, count(*) as n_runs from (
  select user_id, event_type, island, count(*) as n from (select user_id, event_type, row_number() over (partition by user_id order by event_id) - row_number() over (partition by user_id, event_type order by event_id) as island from events) group by all) group by all""",
    "trailing_means": """select event_id, floor(before)::bigint as before, floor(after)::bigint as after from (
  select event_id, avg(value) over (partition by user_id order by event_id rows between 80 preceding and 1 preceding) as before,
    avg(value) over (partition by user_id order by event_id rows between current row and unbounded following) as after
  from (select event_id, user_id, round(value * 100)::bigint as value from events)) where after > 2 * before""",
    "steepest_step": """select user_id, round(step, 4) as step, event_id as at from (select *, row_number() over (partition by user_id order by step desc, event_id) as r from (
  select user_id, event_id, abs(value - lag(value) over (partition by user_id order by event_id)) as step from events) where step is not null) where r = 1""",
    "band_stats": "select event_type, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as spread, round(avg((value < 10)::int), 4) as calm_share, round(quantile_cont(value, 0.25), 4) as quartile from events group by 1",
    "json_props": "select try_cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
}
