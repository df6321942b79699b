"""Licence scan by canonical digest: normalise whole texts, then hash-join them to known licence digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, LICENSES, TITLES

# Spellings that licence matching treats as equal (left is written as right).
SPELLINGS = {"acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "initialise": "initialize", "labelling": "labeling", "licence": "license", "licences": "licenses", "licenced": "licensed", "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http"}

#: A line that is a copyright notice: the word or sign with a year, a sign, a place-holder or `by` after it, or a reservation of all rights.
#: A line of the text itself that happens to begin with the word (`copyright notice and this permission notice ...`) is none.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n(©]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by[ \t])|(\(c\)|©)[ \t]*(copyright[ \t]*)?[0-9<\[{]|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words of letters, marks and digits only (of any script), equivalent spellings made one, single spaces. Null stays null."""
    c = F.lower(text)
    c = F.regexp_replace(c, "(?md)" + COPYRIGHT_LINE, " ")
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(c, SEPARATORS, "  ")), F.lit(" "))  # two spaces between words, so that each word has its own on both sides
    for old, new in sorted(SPELLINGS.items()):
        c = F.replace(c, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.replace(F.trim(c), F.lit("  "), F.lit(" "))


def known_texts() -> list[tuple[str, str]]:
    """(license_id, text) of each known text, without a title and with each title."""
    return [(k, t) for k, texts in sorted(LICENSES.items()) for x in texts for t in (x, *(f"{title}\n\n{x}" for title in TITLES.get(k, [])))]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None, digests: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license_id) of the known texts and digests; of ids with one canonical text the first by name.

    Further licences are further rows: any table of these two columns will do, of any size.
    """
    df = spark.createDataFrame(known_texts() if texts is None else texts, "license_id string, license_text string").select("license_id", F.sha2(canonical(F.col("license_text")), 256).alias("digest"))
    long = [(k, d) for k, ds in (DIGESTS if digests is None else digests).items() for d in ds]
    return df.unionByName(spark.createDataFrame(long, "license_id string, digest string")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_canonical, digest, license_id) for each row: the licence whose canonical text is the row's whole canonical text.

    A null text has a null digest and no licence; an empty one, or one without letters and digits of any script, has the digest of the
    empty string and no licence unless the known table holds that. Repeated rows come back as often; other columns are
    not read. known has one row per digest, so a row never multiplies; no hint is given, as its size decides the join.
    """
    c = docs.select(F.col(id_col), canonical(F.col(text)).alias("_c")).select(id_col, F.length("_c").cast("long").alias("n_canonical"), F.sha2("_c", 256).alias("digest"))
    return c.join(known.select("digest", "license_id"), "digest", "left").select(id_col, "n_canonical", "digest", "license_id")
