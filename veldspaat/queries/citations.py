"""Queries that check references in texts against the records that exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspaat.functions.citations import ARTICLE, KINDS, MARK, outcome
from veldspaat.functions.text import chunks, joined
from veldspaat.operators.events import REFUSAL, REFUSED, answer_events
from veldspaat.operators.grounding import checked, cited, judged, key_table, marked
from veldspaat.operators.quality import covered
from veldspaat.operators.ranking import first_per_key
from veldspaat.plans.shared import written
from veldspaat.queries.retrieval import _corpus_sql, corpus
from veldspaat.queries.sqltext import joined as joined_sql
from veldspaat.sources.tables import table


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """What rulings say, as texts to be checked."""
    rows = first_per_key(table(spark, folder, "kifid"), ["rij_id"], [F.col("rij_id")])
    return rows.select("rij_id", joined(F.col("samenvatting"), F.col("kernoverweging")).alias("antwoord"))


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    return key_table(*(corpus(spark, folder, c) for c in ("wetgeving", "kifid", "polisvoorwaarden")))


def _checks(spark: SparkSession, folder: str) -> DataFrame:
    return checked(cited(_answers(spark, folder), item="rij_id", text=F.col("antwoord")), _keys(spark, folder))


def cite_keys(spark: SparkSession, folder: str) -> DataFrame:
    """How many keys of each kind can be cited."""
    return _keys(spark, folder).groupBy("soort").agg(F.count("*").alias("n"))


def cite_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference in a ruling, once, at its first place."""
    return cited(_answers(spark, folder), item="rij_id", text=F.col("antwoord"))


def cite_checked(spark: SparkSession, folder: str) -> DataFrame:
    """References with whether they are grounded."""
    return _checks(spark, folder).select("rij_id", "soort", "verwijzing", "gefundeerd")


def cite_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every ruling's references."""
    return judged(_answers(spark, folder), _checks(spark, folder), item="rij_id")


def cite_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with ungrounded references marked."""
    return marked(_answers(spark, folder), _checks(spark, folder), item="rij_id", text="antwoord").select("rij_id", "gemaskeerd")


def clause_references(spark: SparkSession, folder: str) -> DataFrame:
    """The references that clauses make, most frequent keys first."""
    found = cited(table(spark, folder, "polisvoorwaarden").select("rij_id", "tekst").distinct(), item="rij_id", text=F.col("tekst"))
    return found.groupBy("soort", "verwijzing").agg(F.count("*").alias("n"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """The events by which each answer is sent, its sources being the records that it rightly cites; without any it is refused."""
    answers, checks = _answers(spark, folder), written(_checks(spark, folder), "checks")
    sources = checks.where("gefundeerd").groupBy("rij_id").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "soort", "verwijzing"))).alias("sources"))
    notes = table(spark, folder, "kifid").groupBy("rij_id").agg(F.max("pdf_leesfout").alias("error"))
    rows = answers.join(sources, "rij_id", "left").join(notes, "rij_id").join(marked(answers, checks, item="rij_id", text="antwoord").select("rij_id", F.col("gemaskeerd").alias("masked")), "rij_id")
    return answer_events(rows.withColumnRenamed("antwoord", "answer"), judged(answers, checks, item="rij_id"), item="rij_id")


def chunk24(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries in pieces of 24 characters."""
    rows = table(spark, folder, "kifid").where("samenvatting is not null").select("rij_id", "samenvatting").distinct()
    return rows.select("rij_id", F.posexplode(chunks(F.col("samenvatting"), 24)).alias("place", "data"))


def basis_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """References of clauses to articles and members: is there such an article, and such a member?"""
    text = table(spark, folder, "polisvoorwaarden").select("rij_id", "tekst").distinct()
    number, member = F.regexp_extract_all("tekst", F.lit(ARTICLE), F.lit(1)), F.regexp_extract_all("tekst", F.lit(ARTICLE), F.lit(2))
    found = text.select(F.inline(F.arrays_zip(number.alias("artikel"), member.alias("lid")))).where(F.contains("artikel", F.lit(":")))
    found = found.select(F.lower("artikel").alias("artikel"), F.nullif("lid", F.lit("")).alias("lid")).groupBy("artikel", "lid").agg(F.count("*").alias("n"))
    laws = corpus(spark, folder, "wetgeving").where("leden is not null")
    laws = laws.groupBy(F.lower(F.trim("artikel")).alias("artikel")).agg(F.array_distinct(F.flatten(F.collect_list("leden"))).alias("leden"))
    return covered(found, laws, key="artikel", member="lid", members="leden").groupBy("covered").agg(F.count("*").alias("n_refs"), F.sum("n").alias("n"))


def verdict_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Rulings by stored verdict and the one their own wording supports."""
    found = table(spark, folder, "kifid").select("oordeel", outcome(F.col("uitkomst_letterlijk"), F.col("beslissing_letterlijk")).alias("o"))
    return found.groupBy("oordeel", F.col("o.oordeel").alias("gelezen"), F.col("o.herkomst").alias("herkomst")).agg(F.count("*").alias("n"))


_ANSWERS = f"(select rij_id, {joined_sql('samenvatting', 'kernoverweging')} as antwoord from kifid qualify row_number() over (partition by rij_id) = 1)"


def _found_sql(texts: str, text: str) -> str:
    parts = [f"select rij_id, '{k}' as soort, lower(unnest(regexp_extract_all({text}, '{p}', 1))) as verwijzing from {texts}" for k, p in KINDS]
    return "select distinct * from (" + " union all ".join(parts) + ")"


_KEYS = f"""select distinct soort, verwijzing from (
  select 'wetsartikel' as soort, unnest([lower(trim(artikel)), trim(replace(replace(lower(trim(artikel)), 'art.', ''), 'artikel', ''))]) as verwijzing from {_corpus_sql("wetgeving")}
  union all select 'kifid', trim(uitspraaknummer) from {_corpus_sql("kifid")}
  union all select 'polisclausule', unnest([lower(trim(clausule_id)), trim(regexp_replace(lower(trim(clausule_id)), '^art(?:ikel)?\\.?\\s*', ''))]) from {_corpus_sql("polisvoorwaarden")}
) where verwijzing <> ''"""
_CHECKED = f"""select * from (select f.*, k.verwijzing is not null as gefundeerd from ({_found_sql(_ANSWERS, "antwoord")}) f
  left join ({_KEYS}) k on f.soort = k.soort and f.verwijzing = k.verwijzing)
  where gefundeerd or soort <> 'wetsartikel' or contains(verwijzing, ':')"""
_DECIDED = """case
  when regexp_matches(b, 'klacht (?:is |wordt )?(?:deels|gedeeltelijk) gegrond|verklaart de klacht (?:deels|gedeeltelijk) gegrond') then 'gedeeltelijk gegrond/expliciet in beslissing'
  when regexp_matches(b, 'klacht (?:is|wordt)? ?ongegrond|verklaart de klacht ongegrond') then 'ongegrond/expliciet in beslissing'
  when regexp_matches(b, 'verklaart de klacht gegrond|\\bklacht is gegrond\\b') then 'gegrond/expliciet in beslissing'
  when regexp_matches(b, '^\\s*de commissie verklaart de (?:klacht niet[- ]behandelbaar|consument niet[- ]ontvankelijk)\\.?\\s*$') then 'niet-ontvankelijk/expliciet in beslissing'
  when regexp_matches(u, 'niet[- ]ontvankelijk') then 'niet-ontvankelijk/kopregel Uitkomst'
  when regexp_matches(u, 'niet[- ]behandelbaar') then case when regexp_matches(u, 'gedeeltelijk|deels') then null else 'niet-ontvankelijk/kopregel Uitkomst' end
  when u in ('vordering afgewezen', 'vordering geheel afgewezen') then 'ongegrond/kopregel Uitkomst'
  when u in ('vordering toegewezen', 'vordering geheel toegewezen') then 'gegrond/kopregel Uitkomst'
  when u in ('vordering gedeeltelijk toegewezen', 'vordering (gedeeltelijk) toegewezen', 'vordering deels toegewezen', 'vordering gedeeltelijk afgewezen') then 'gedeeltelijk gegrond/kopregel Uitkomst'
  when u <> '' then null
  when regexp_matches(b, '^\\s*de commissie wijst de vordering(?:en)?(?: van de consument)? af\\.?\\s*$') then 'ongegrond/letterlijke beslissing' end"""

_PLACES = " union all ".join(
    f"""select rij_id, '{k}' as soort, lower(keys[i]) as verwijzing, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::int as positie
  from (select *, unnest(range(1, len(hits) + 1)) as i from (select rij_id, regexp_extract_all(antwoord, '{p}', 0) as hits, regexp_extract_all(antwoord, '{p}', 1) as keys, string_split_regex(antwoord, '{p}') as gaps from {_ANSWERS}))"""
    for k, p in KINDS
)
_WORD = "[^\\p{L}\\p{M}\\p{N}\\p{Pc}{}]"
_MASKED = f"""select a.rij_id, antwoord, coalesce(list_reduce(wrong, lambda t, v: regexp_replace(t, '(^|{_WORD.replace("{}", ">")})(' || regexp_escape(v) || ')($|{_WORD.replace("{}", "<")})', '\\1\\2{MARK}\\3'), antwoord), antwoord) as gemaskeerd
  from {_ANSWERS} a left join (select rij_id, list(verwijzing order by soort, verwijzing) as wrong from ({_CHECKED}) where not gefundeerd group by rij_id) w on a.rij_id = w.rij_id"""
_SENT = f"""(select m.rij_id, antwoord, gemaskeerd, s.sources, e.error from ({_MASKED}) m
  left join (select rij_id, list_sort(list(distinct soort || ' ' || verwijzing)) as sources from ({_CHECKED}) where gefundeerd group by rij_id) s on m.rij_id = s.rij_id
  join (select rij_id, max(pdf_leesfout) as error from kifid group by 1) e on m.rij_id = e.rij_id)"""

QUERIES = {f.__name__: f for f in (cite_keys, cite_extract, cite_checked, cite_verdict, cite_mask, clause_references, event_log, chunk24, basis_coverage, verdict_normalise)}
SQL = {
    "cite_keys": f"select soort, count(*) as n from ({_KEYS}) group by soort",
    "cite_checked": _CHECKED,
    "cite_verdict": f"""select a.rij_id, case when coalesce(o, 0) > 0 then 'ONGEFUNDEERD' when coalesce(g, 0) > 0 then 'GEFUNDEERD' else 'GEEN_VERWIJZINGEN' end as oordeel,
  coalesce(g, 0) as n_gefundeerd, coalesce(o, 0) as n_ongefundeerd
  from {_ANSWERS} a left join (select rij_id, count(*) filter (gefundeerd) as g, count(*) filter (not gefundeerd) as o from ({_CHECKED}) group by rij_id) c on a.rij_id = c.rij_id""",
    "cite_extract": f"select rij_id, soort, verwijzing, min(positie) as positie from ({_PLACES}) group by all",
    "cite_mask": f"select rij_id, gemaskeerd from ({_MASKED})",
    "event_log": f"""
with sent as {_SENT}, verdict as (select rij_id, max(case when gefundeerd then 0 else 1 end) as wrong from ({_CHECKED}) group by rij_id)
select rij_id, 0 as phase, 0 as place, 'bronnen' as event, coalesce(cast(to_json(sources) as varchar), '[]') as data from sent
union all select rij_id, 1, 0, 'tekst', '{REFUSAL}' from sent where sources is null
union all select rij_id, 1, i::int, 'tekst', substr(antwoord, i * 24 + 1, 24) from (select rij_id, antwoord, unnest(range(0, (length(antwoord) + 23) // 24)) as i from sent where sources is not null)
union all select rij_id, 2, 0, 'fout', error from sent where sources is not null and error is not null
union all select s.rij_id, 3, 0, 'controle', case when sources is null then '{REFUSED}' when wrong = 1 then 'ONGEFUNDEERD' else 'GEFUNDEERD' end from sent s left join verdict v on s.rij_id = v.rij_id
union all select rij_id, 4, 0, 'gemaskeerd', gemaskeerd from sent where sources is not null and gemaskeerd <> antwoord
union all select rij_id, 5, 0, 'einde', '[DONE]' from sent""",
    "clause_references": f"select soort, verwijzing, count(*) as n from ({_found_sql('(select distinct rij_id, tekst from polisvoorwaarden)', 'tekst')}) group by all",
    "chunk24": """select rij_id, i::int as place, substr(samenvatting, i * 24 + 1, 24) as data from (
  select rij_id, samenvatting, unnest(range(0, (length(samenvatting) + 23) // 24)) as i from (select distinct rij_id, samenvatting from kifid where samenvatting is not null))""",
    "basis_coverage": f"""
with refs as (select lower(a) as artikel, nullif(l, '') as lid, count(*) as n from (
    select unnest(regexp_extract_all(tekst, '{ARTICLE}', 1)) as a, unnest(regexp_extract_all(tekst, '{ARTICLE}', 2)) as l from (select distinct rij_id, tekst from polisvoorwaarden)
  ) where contains(a, ':') group by all),
laws as (select lower(trim(artikel)) as artikel, flatten(list(leden)) as leden from {_corpus_sql("wetgeving")} where leden is not null group by 1)
select covered, count(*) as n_refs, sum(n)::bigint as n from (
  select n, case when w.artikel is null then 'no record' when lid is null or len(list_filter(leden, lambda m: starts_with(trim(m), lid || '.'))) > 0 then 'covered' else 'no member' end as covered
  from refs r left join laws w on r.artikel = w.artikel) group by covered""",
    "verdict_normalise": f"""
with t as (select oordeel, lower(coalesce(beslissing_letterlijk, '')) as b,
    replace(regexp_replace(regexp_replace(lower(coalesce(uitkomst_letterlijk, '')), '\\s+', ' ', 'g'), '^[ .:]+|[ .:]+$', '', 'g'), 'vorderingen', 'vordering') as u from kifid),
r as (select oordeel, {_DECIDED} as r from t)
select oordeel, split_part(r, '/', 1) as gelezen, split_part(r, '/', 2) as herkomst, count(*) as n from r group by all""",
}
