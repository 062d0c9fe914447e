"""The three corpora: schemas, indexed fields, JSON reading with visible failures, JSON and CSV writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspaat.operators.gate import gate_status

WETGEVING = (
    "wet string, bwb_id string, artikel string, titel string, tekst string, leden array<string>, onderwerp string, structuur array<string>, geldig_op date, "
    "toestand_einddatum date, bron_url string, bron_xml_url string, bron_verificatie_url string, bron_geverifieerd boolean, opgehaald_op date"
)
KIFID = (
    "uitspraaknummer string, datum string, titel string, categorie string, kern_klacht string, samenvatting string, kernoverweging string, kernoverweging_bron string, "
    "thema string, oordeel string, bindend boolean, oordeel_herkomst string, uitkomst_letterlijk string, beslissing_letterlijk string, aard_uitspraak_letterlijk string, "
    "bron_url string, pdf_url string, opgehaald_op string, instantie string, verweerder string, kop_layout string, datum_uit_uitspraaktekst string, datum_uit_api string, "
    "kifid_onderwerp_tags array<string>, bron_url_http_status int, nummer_in_ruwe_html_bronpagina boolean, nummer_url_binding_geverifieerd boolean, pdf_http_status int, "
    "nummer_in_pdf boolean, pdf_leesfout string, bron_geverifieerd boolean, bron_soort string, bron_verificatie_notitie string, uitkomst_letterlijk_uit_pdf string, "
    "pdf_bytes long, bron_html_redirect_naar_register boolean, audit_bevinding string"
)
POLISVOORWAARDEN = (
    "product string, verzekeraar_of_bron string, document string, clausule_id string, kop string, tekst string, type string, bron_url string, bron_http_status int, "
    "bron_pdf_sha256 string, opgehaald_op date"
)
#: Column definitions of each corpus; parsed when a session is there.
SCHEMAS = {"wetgeving": WETGEVING, "kifid": KIFID, "polisvoorwaarden": POLISVOORWAARDEN}
#: What a record of each corpus is called.
NAMES = {"wetgeving": "artikel", "kifid": "uitspraaknummer", "polisvoorwaarden": "clausule_id"}
#: The fields of each corpus that retrieval indexes.
FIELDS = {
    "kifid": ("uitspraaknummer", "titel", "kern_klacht", "samenvatting", "kernoverweging", "categorie"),
    "wetgeving": ("wet", "artikel", "titel", "tekst", "onderwerp"),
    "polisvoorwaarden": ("product", "clausule_id", "kop", "tekst", "type", "verzekeraar_of_bron"),
}


def schema_of(corpus: str) -> T.StructType:
    """The schema of a corpus."""
    return T.StructType.fromDDL(SCHEMAS[corpus])


def read_corpus(spark: SparkSession, path: str, schema: T.StructType, *, lines: bool = False) -> DataFrame:
    """Records of a JSON file that is an array or an object with an array ``records``; nothing is inferred.

    Values that aren't objects become no records, nor does an object without ``records``. A file that isn't JSON, or was
    cut off, fails when it is read. With ``lines`` each line is a record, files are split over tasks, and a line that isn't
    an object fails.
    """
    if lines:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    text = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("value"))
    if text.isEmpty():  # Spark passes over files without content
        raise ValueError(f"nothing in {path}")
    parsed = F.try_parse_json("value")
    whole = text.select(F.when(parsed.isNull(), F.raise_error(F.lit("no valid JSON")).cast("variant")).otherwise(parsed).alias("v"))
    held = F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.try_variant_get("v", "$.records", "variant")).otherwise(F.col("v"))
    lists = whole.select(held.alias("v")).where(F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")))
    values = lists.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).where(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")))
    return values.select(F.from_json(F.to_json("value"), schema).alias("r")).select("r.*")


def load_status(spark: SparkSession, paths: dict[str, str], *, lines: bool = False, most: int = 10) -> DataFrame:
    """(corpus, geladen, records, geweigerd, geweigerde_ids, fout): every named corpus, loaded or with the error that kept it out.

    records are the usable ones; geweigerd those that are explicitly unverified, with the first ``most`` of their ids in
    order. Never raises.
    """
    rows = []
    for name, path in paths.items():
        try:
            status = gate_status(read_corpus(spark, path, schema_of(name), lines=lines), verified=F.col("bron_geverifieerd") if "bron_geverifieerd" in SCHEMAS[name] else F.lit(None).cast("boolean"), names=[F.col(NAMES[name])], most=most).first()
            rows.append((name, True, status["usable"], status["refused"], status["refused_ids"], None))
        except Exception as error:  # noqa: BLE001 - whatever the source does, the others must load
            rows.append((name, False, 0, 0, "", str(error).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "corpus string, geladen boolean, records long, geweigerd long, geweigerde_ids string, fout string")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line; null fields are kept, so that a reader sees every column."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_form(df: DataFrame, path: str, *, label: str, questions: list[str]) -> None:
    """A rating form as CSV with a header: the labels and an empty column per question."""
    df.select(label, *[F.lit(None).cast("string").alias(q) for q in questions]).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
