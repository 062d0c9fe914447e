"""Queries on records composed from landed parts, on files and manifests, on sides of a comparison, and on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspaat.functions.addresses import BLOCKED, HEAD, LEAST_BYTES, LEAST_PRINT, captured, print_kept, print_key, reachable
from veldspaat.functions.citations import basis_parts
from veldspaat.functions.text import collapse
from veldspaat.operators.passages import RULES, block, prompt
from veldspaat.operators.quality import covered
from veldspaat.operators.ranking import first_per_key
from veldspaat.operators.records import described, file_of, in_order, joined_pages, live, merged_sets, ruling_records, united, with_parts
from veldspaat.operators.retrieval import bm25
from veldspaat.plans.joins import sized_join
from veldspaat.plans.shared import shared_folder, written
from veldspaat.queries import retrieval, sqltext
from veldspaat.sources.corpora import NAMES, SCHEMAS, load_status, write_json
from veldspaat.sources.tables import table
from veldspaat.streaming.checks import arriving, gated, landed



def ruling_record(spark: SparkSession, folder: str) -> DataFrame:
    """Rulings read from search results and prints laid out from the table, as far as their address answered with 200."""
    rows = first_per_key(table(spark, folder, "kifid"), ["rij_id"], [F.col("rij_id")])
    day = F.col("datum_uit_api").cast("date")
    print_ = F.concat(
        F.lit("Uitspraak Aard uitspraak Bindend advies Uitkomst "), F.coalesce(collapse(F.col("uitkomst_letterlijk")), F.lit("")), F.lit(" Bijlage 1 \n1. De kern "),
        F.coalesce(F.col("kern_klacht"), F.lit("")), F.lit("\n2. Procedure\nDe stukken zijn gewisseld.\n3. De beslissing "), F.coalesce("beslissing_letterlijk", F.lit("")), F.lit(" Deze uitspraak is bindend."),
    )
    items = live(rows, F.col("bron_url_http_status")).select(
        F.concat_ws(" ", F.lit("Uitspraak"), "uitspraaknummer", "titel").alias("title"),
        F.when(F.col("kern_klacht").isNotNull(), print_).alias("text"),
        ((F.unix_date(day) * 86400 + 62_135_596_800) * 10_000_000).alias("ticks"),
        F.col("bron_url").alias("url"),
        F.col("categorie").alias("category"),
        F.concat(F.lit("<p>"), F.replace("samenvatting", F.lit("&"), F.lit("&amp;")), F.lit("</p>")).alias("summary"),
        F.col("instantie").alias("authority"),
        F.col("verweerder").alias("defendant"),
        F.array_join("kifid_onderwerp_tags", ", ").alias("tags"),
        "pdf_url",
        "thema",
        "opgehaald_op",
    )
    found = ruling_records(items, theme=F.col("thema"), fetched=F.col("opgehaald_op"))
    return found.groupBy("uitspraaknummer", "datum", "categorie", "bindend", "instantie", "thema", "datum_uit_api", "kop_layout").agg(F.count("*").alias("n"), F.count("kern_klacht").alias("met_kern"))


def basis_members(spark: SparkSession, folder: str) -> DataFrame:
    """Bases written for every member of every article, split into key and member and looked up again: are they covered?"""
    laws = table(spark, folder, "wetgeving").where("wet is not null and artikel is not null")
    book = F.when(F.col("wet") == "BW", F.concat(F.lit("BW:"), F.when(F.contains("artikel", F.lit(":")), F.col("artikel")).otherwise(F.concat(F.lit("7:"), "artikel")))).otherwise(F.concat_ws(":", "wet", "artikel"))
    named = laws.select(book.alias("sleutel"), "leden").distinct()
    written_as = named.select("sleutel", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("leden"), F.lit(0)))).alias("lid")).distinct()
    basis = written_as.select(F.when(F.col("lid") > 0, F.concat_ws(":", "sleutel", F.col("lid").cast("string"))).otherwise(F.col("sleutel")).alias("basis"))
    parts = basis.select("basis", basis_parts(F.col("basis")).alias("p")).select("basis", F.col("p.key").alias("sleutel"), F.col("p.member").alias("lid"))
    records = named.where("leden is not null").groupBy("sleutel").agg(F.array_distinct(F.flatten(F.collect_list("leden"))).alias("leden"))
    return covered(parts, records, key="sleutel", member="lid", members="leden").select("basis", "sleutel", "lid", "covered")


def clause_sides(spark: SparkSession, folder: str) -> DataFrame:
    """Each product beside the next one of its insurer: the six clauses found for either side, a clause found for both kept twice."""
    rows = table(spark, folder, "polisvoorwaarden").where("product is not null")
    names = rows.where("verzekeraar_of_bron is not null").select("verzekeraar_of_bron", "product").distinct()
    later = F.lead("product").over(Window.partitionBy("verzekeraar_of_bron").orderBy("product"))
    pairs = names.select(F.col("product").alias("product_a"), later.alias("product_b")).where("product_b is not null").distinct()
    asked = rows.select("product").distinct().select("product", F.concat("product", F.lit(" uitsluiting dekking eigen risico")).alias("vraag"))
    hits = bm25(retrieval.corpus(spark, folder, "polisvoorwaarden"), asked, item="rij_id", text=retrieval._text("polisvoorwaarden"), query="product", query_text=F.col("vraag"), k=6)
    hits, pairs = written(hits.select("product", "rij_id", "rank"), "hits"), written(pairs, "pairs")
    sides = [sized_join(pairs, hits.withColumnRenamed("product", f"product_{s}"), [f"product_{s}"]).select("product_a", "product_b", F.lit(s.upper()).alias("kant"), "rank", "rij_id") for s in "ab"]
    return sides[0].unionByName(sides[1])


def united_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Three sets in one, told apart: how many records each has, how many are named and how long they are together."""
    text = {"wetgeving": "tekst", "kifid": "samenvatting", "polisvoorwaarden": "tekst"}
    sets = {c: table(spark, folder, c).select(F.col(NAMES[c]).alias("naam"), F.col(t).alias("tekst"), *([F.col("thema")] if c == "kifid" else [])) for c, t in text.items()}
    return united(sets, kind="soort").groupBy("soort", "thema").agg(F.count("*").alias("n"), F.count("naam").alias("met_naam"), F.coalesce(F.sum(F.length("tekst")), F.lit(0)).alias("n_chars"))


def pages_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The clauses of every delivered print joined as its pages, in order, and cleaned."""
    pages = table(spark, folder, "polis_levering").where("bron_url is not null and opgehaald_op is not null")
    found = joined_pages(pages, document=["bron_url", "opgehaald_op"], page=["clausule_id", "ingelezen_op"], text="tekst")
    return found.select("bron_url", F.date_format("opgehaald_op", "yyyy-MM-dd").alias("opgehaald_op"), "n_pages", F.length("text").alias("n_chars"))


def files_described(spark: SparkSession, folder: str) -> DataFrame:
    """The files of all deliveries with what the current catalogue says of them, and the products that each is used for."""
    rows, now = table(spark, folder, "polis_levering"), table(spark, folder, "polisvoorwaarden")
    files = rows.select(file_of(F.col("bron_url")).alias("bestand")).where("bestand is not null").distinct()
    named = now.select(file_of(F.col("bron_url")).alias("bestand"), "document", "verzekeraar_of_bron").where("bestand is not null")
    manifest = named.groupBy("bestand").agg(F.min("document").alias("naam"), F.min("verzekeraar_of_bron").alias("omschrijving"))
    parts = now.select(file_of(F.col("bron_url")).alias("bestand"), "product").where("bestand is not null and product is not null")
    found = with_parts(described(files, manifest, file="bestand", name="naam", description="omschrijving"), parts, file="bestand", part="product", name="producten")
    return found.select("bestand", "naam", "omschrijving", F.array_join("producten", "|").alias("producten"))


def manifest_order(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each clause, dropped if its file is gone, at the place of its product in the catalogue, exclusions first."""
    rows, now = table(spark, folder, "polis_levering"), table(spark, folder, "polisvoorwaarden")
    latest = rows.groupBy("product", "clausule_id").agg(F.max(F.struct("opgehaald_op", "ingelezen_op", "bron_url", "type")).alias("r")).select("product", "clausule_id", "r.bron_url", "r.type")
    there = now.select("bron_url").where("bron_url is not null").distinct()
    names = now.where("product is not null").groupBy("verzekeraar_of_bron", "product").agg(F.lit(1).alias("_"))
    place = names.groupBy("product").agg(F.count("*").cast("int").alias("plaats"))
    found = in_order(latest.join(there, "bron_url", "left_semi"), place, key="product", place="plaats", first=F.col("type") == "uitsluiting")
    return found.select("product", "clausule_id", F.col("plaats.n").alias("plaats"), F.col("plaats.m").alias("daarbinnen"))


def sets_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses kept and left out after the last delivery: by those of the two before, and those that failed to arrive."""
    rows = table(spark, folder, "polis_levering").where("opgehaald_op is not null and product is not null and clausule_id is not null").select("opgehaald_op", "product", "clausule_id").distinct()
    rows = written(rows, "keys")
    days = rows.select("opgehaald_op").distinct().orderBy(F.desc("opgehaald_op")).limit(3).agg(F.array_sort(F.collect_list("opgehaald_op")).alias("_days"))
    marked = rows.withColumn("_one", F.lit(1)).join(F.broadcast(days.withColumn("_one", F.lit(1))), "_one")

    def of(back: int) -> DataFrame:
        return marked.where(F.col("opgehaald_op") == F.get("_days", F.size("_days") - 1 - back)).select("product", "clausule_id")

    key = ["product", "clausule_id"]
    kept, out = merged_sets(of(1), of(0), key=key, left_out=of(2).join(of(1), key, "left_anti"), newly_left_out=of(1).join(of(0), key, "left_anti"))
    return kept.select(*key, F.lit("behouden").alias("staat")).unionByName(out.select(*key, F.lit("overgeslagen").alias("staat")))


def print_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The prints of rulings: the file each is kept under, whether it can be the print, and whether its address is reachable."""
    rows = table(spark, folder, "kifid").where("pdf_url is not null").select("rij_id", "pdf_url", "pdf_bytes", "pdf_http_status").distinct()
    return rows.select("rij_id", print_key(F.col("pdf_url")).alias("bestand"), print_kept(F.col("pdf_bytes")).alias("bewaard"), reachable(F.col("pdf_http_status")).alias("bereikbaar"))


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as captures, the size in bytes of their text: which show their page."""
    rows = table(spark, folder, "documents")
    return rows.groupBy("source", captured(F.octet_length("text"), F.col("text")).alias("getoond")).agg(F.count("*").alias("n"))


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The instructions for each theme's first ruling with that ruling as their context; none for rulings without a text."""
    rows = first_per_key(table(spark, folder, "kifid").where("thema is not null"), ["thema"], [F.asc("rij_id")])
    return rows.select("thema", prompt(F.when(F.coalesce("samenvatting", "kern_klacht").isNotNull(), block("kifid"))).alias("prompt"))


def clauses_cut(spark: SparkSession, folder: str) -> DataFrame:
    """The second member of each article cut out of its text without its number, in paragraphs, or why it can't be."""
    from veldspaat.functions.text import clause_between

    rows = first_per_key(table(spark, folder, "wetgeving").where("size(leden) > 2"), ["rij_id"], [F.col("rij_id")])
    marker = lambda i: F.left(F.get("leden", F.lit(i)), F.lit(30))
    cut = clause_between(F.col("tekst"), marker(1), marker(2), F.lit("2."))
    found = rows.select("rij_id", cut.alias("c"))
    return found.select("rij_id", F.coalesce(F.length(collapse(F.col("c.cut"))), F.lit(-1)).alias("n_chars"), F.col("c.error").alias("error"))


def corpora_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The three corpora written as JSON and loaded again: usable and refused records, the first refused names, and errors."""
    base = f"{shared_folder(spark)}/veldspaat/corpora-{uuid.uuid4().hex}"
    for c in SCHEMAS:
        columns = [f.split()[0] for f in SCHEMAS[c].replace("array<string>", "strings").split(", ")]
        write_json(table(spark, folder, c).select(*columns), f"{base}/{c}")
    return load_status(spark, {c: f"{base}/{c}" for c in SCHEMAS}, lines=True)


def stream_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The laws that pass the gate, arriving as a stream of files: articles by law."""
    laws = table(spark, folder, "wetgeving")
    base = f"{shared_folder(spark)}/veldspaat/stream-{uuid.uuid4().hex}"
    passed = gated(arriving(spark, f"{folder}/wetgeving.parquet*", laws.schema), verified=F.col("bron_geverifieerd")).select("rij_id", "wet", "artikel")
    landed(passed, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(passed.schema).parquet(f"{base}/out").groupBy("wet").agg(F.count("*").alias("n"), F.count_distinct("artikel").alias("artikelen"))


_Q = sqltext.collapse
_KEYS = "(select distinct opgehaald_op, product, clausule_id from polis_levering where opgehaald_op is not null and product is not null and clausule_id is not null)"
_DAYS = f"(select list(d order by d desc) as days from (select distinct opgehaald_op as d from {_KEYS} order by 1 desc limit 3))"


def _of(back: int) -> str:
    return f"(select product, clausule_id from {_KEYS}, {_DAYS} where opgehaald_op = days[{back + 1}])"


_FILE = "nullif(regexp_replace(string_split(bron_url, '/')[-1], '[?#].*$', ''), '')"
QUERIES = {
    f.__name__: f
    for f in (
        ruling_record, basis_members, clause_sides, united_sets, pages_joined, files_described, manifest_order, sets_merged, print_cache, captures, prompts, clauses_cut, corpora_loaded, stream_gate,
    )
}
_TITLE = "concat_ws(' ', 'Uitspraak', uitspraaknummer, titel)"
SQL = {
    "ruling_record": f"""
with r as (select * from kifid where bron_url_http_status = 200 and coalesce(bron_url, '') <> '' and kern_klacht is not null qualify row_number() over (partition by rij_id) = 1),
k as (select *, {_Q("kern_klacht")} as kern from r)
select regexp_extract({_Q(_TITLE)}, '(\\d{{4}}-\\d{{3,5}})', 1) as uitspraaknummer, strftime(cast(datum_uit_api as date), '%Y-%m-%d') as datum, {_Q("nullif(categorie, '')")} as categorie, true as bindend,
  {_Q("nullif(instantie, '')")} as instantie, thema, strftime(cast(datum_uit_api as date), '%Y-%m-%d') as datum_uit_api, 'fwd' as kop_layout, count(*) as n,
  count(*) filter (length({_Q("regexp_extract(' ' || kern_klacht || chr(10) || '2. Procedure', '(?s)^(.*?)[^0-9A-Za-z_][0-9]\\s*\\.\\s*[A-Z]', 1)")}) >= 60) as met_kern
from k where regexp_matches({_Q(_TITLE)}, '\\d{{4}}-\\d{{3,5}}') group by all""",
    "basis_members": """
with laws as (select distinct case when wet = 'BW' then 'BW:' || case when contains(artikel, ':') then artikel else '7:' || artikel end else wet || ':' || artikel end as sleutel, leden from wetgeving where wet is not null and artikel is not null),
bases as (select distinct case when lid > 0 then sleutel || ':' || lid else sleutel end as basis from (select sleutel, unnest(range(0, coalesce(len(leden), 0) + 1)) as lid from laws)),
parts as (select basis, string_split(basis, ':') as p from bases),
split as (select basis, case when p[1] = 'BW' then array_to_string(p[1:3], ':') else array_to_string(p[1:2], ':') end as sleutel, case when p[1] = 'BW' then p[4] else p[3] end as lid from parts),
records as (select sleutel, flatten(list(leden)) as leden from laws where leden is not null group by 1)
select basis, s.sleutel, lid, case when r.sleutel is null then 'no record' when lid is null or len(list_filter(leden, lambda m: starts_with(trim(m), lid || '.'))) > 0 then 'covered' else 'no member' end as covered
from split s left join records r on s.sleutel = r.sleutel""",
    "clause_sides": f"""
with hits as ({retrieval.SQL["clause_compare"]}),
pairs as (select distinct product as product_a, later as product_b from (select product, lead(product) over (partition by verzekeraar_of_bron order by product) as later
  from (select distinct verzekeraar_of_bron, product from polisvoorwaarden where product is not null and verzekeraar_of_bron is not null)) where later is not null)
select product_a, product_b, 'A' as kant, rank, rij_id from pairs join hits on hits.product = product_a
union all select product_a, product_b, 'B', rank, rij_id from pairs join hits on hits.product = product_b""",
    "united_sets": """select soort, thema, count(*) as n, count(naam) as met_naam, coalesce(sum(length(tekst)), 0)::bigint as n_chars from (
  select 'wetgeving' as soort, cast(null as varchar) as thema, artikel as naam, tekst from wetgeving union all select 'kifid', thema, uitspraaknummer, samenvatting from kifid
  union all select 'polisvoorwaarden', null, clausule_id, tekst from polisvoorwaarden) group by all""",
    "pages_joined": f"""select bron_url, opgehaald_op, n_pages, length({sqltext.clean("raw")})::int as n_chars from (
  select bron_url, strftime(opgehaald_op, '%Y-%m-%d') as opgehaald_op, count(*)::int as n_pages,
    string_agg(coalesce(tekst, ''), chr(10) order by clausule_id nulls first, ingelezen_op nulls first, coalesce(tekst, '')) as raw from polis_levering where bron_url is not null and opgehaald_op is not null group by all)""",
    "files_described": f"""
with files as (select distinct {_FILE} as bestand from polis_levering where {_FILE} is not null),
known as (select {_FILE} as bestand, min(document) as naam, min(verzekeraar_of_bron) as omschrijving, array_to_string(list_sort(list(distinct product) filter (product is not null)), '|') as producten from polisvoorwaarden where {_FILE} is not null group by 1)
select f.bestand, coalesce(nullif(naam, ''), regexp_replace(f.bestand, '\\.[^.]*$', '')) as naam, coalesce(omschrijving, '') as omschrijving, coalesce(producten, '') as producten from files f left join known k on f.bestand = k.bestand""",
    "manifest_order": """
with latest as (select product, clausule_id, bron_url, type from polis_levering qualify row_number() over (partition by product, clausule_id
  order by opgehaald_op desc nulls last, ingelezen_op desc nulls last, bron_url desc nulls last, type desc nulls last) = 1),
place as (select product, count(distinct coalesce(verzekeraar_of_bron, '-'))::int as plaats from polisvoorwaarden where product is not null group by 1)
select l.product, clausule_id, coalesce(plaats, 999) as plaats, case when type = 'uitsluiting' then 0 else 1 end as daarbinnen from latest l left join place p on l.product = p.product
where bron_url in (select bron_url from polisvoorwaarden where bron_url is not null)""",
    "sets_merged": f"""
with a as (from {_of(1)}), b as (from {_of(0)}), c as (from {_of(2)}),
kept as (select * from a where (product, clausule_id) not in (from b) union all from b),
failed as (select * from a where (product, clausule_id) not in (from b)), before as (select * from c where (product, clausule_id) not in (from a))
select *, 'behouden' as staat from kept union all
select *, 'overgeslagen' from before where (product, clausule_id) not in (from failed) and (product, clausule_id) not in (from kept) union all
select *, 'overgeslagen' from failed where (product, clausule_id) not in (from kept)""",
    "print_cache": f"""select distinct rij_id, sha1(pdf_url) || '.pdf' as bestand, coalesce(pdf_bytes, 0) > {LEAST_PRINT} as bewaard, coalesce(pdf_http_status in (200, 206), false) as bereikbaar from kifid where pdf_url is not null""",
    "captures": f"""select source, coalesce(strlen(text), 0) > {LEAST_BYTES} and not ({" or ".join(f"contains(lower(left(coalesce(text, ''), {HEAD})), '{p.lower()}')" for p in BLOCKED)}) as getoond, count(*) as n from documents group by all""",
    "prompts": f"""select thema, '{RULES.replace("'", "''")}' || case when coalesce(samenvatting, kern_klacht) is not null then {retrieval._BLOCK["kifid"]} else '(geen bronnen gevonden)' end as prompt
from kifid where thema is not null qualify row_number() over (partition by thema order by rij_id) = 1""",
    "clauses_cut": f"""
with t as (select rij_id, {_Q("tekst")} as t, {_Q("left(leden[2], 30)")} as a, {_Q("left(leden[3], 30)")} as b from wetgeving where len(leden) > 2 qualify row_number() over (partition by rij_id) = 1),
n as (select *, (length(t) - length(replace(t, a, ''))) // length(a) as na, (length(t) - length(replace(t, b, ''))) // length(b) as nb from t),
c as (select rij_id, trim(substr(t, strpos(t, a), strpos(t, b) - strpos(t, a))) as piece,
  case when na <> 1 then 'start ' || na || 'x' when nb <> 1 then 'end ' || nb || 'x' when strpos(t, b) <= strpos(t, a) then 'end before start' end as error from n)
select rij_id, (case when error is null and starts_with(piece, '2.') then length(ltrim(substr(piece, 3))) else -1 end)::int as n_chars,
  coalesce(error, case when not starts_with(piece, '2.') then 'lead not at the beginning' end) as error from c""",
    "corpora_loaded": " union all ".join(
        f"""select '{c}' as corpus, true as geladen, count(*) filter (({v}) is distinct from false) as records, count(*) filter (({v}) is not distinct from false) as geweigerd,
  (select coalesce(string_agg(i, ',' order by i), '') from (select {NAMES[c]} as i from {c} where ({v}) is not distinct from false and {NAMES[c]} <> '' order by 1 limit 10)) as geweigerde_ids, cast(null as varchar) as fout from {c}"""
        for c, v in (("wetgeving", "bron_geverifieerd"), ("kifid", "bron_geverifieerd"), ("polisvoorwaarden", "cast(null as boolean)"))
    ),
    "stream_gate": "select wet, count(*) as n, count(distinct artikel) as artikelen from wetgeving where bron_geverifieerd is distinct from false group by 1",
}
