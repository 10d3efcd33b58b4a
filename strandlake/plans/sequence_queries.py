"""Queries of the sequence engine over the test tables, each with the SQL that gives the same rows.

Documents stand for proteins: their letters are the sequence, their source is the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import peptide_properties as props
from ..functions.hashing import ordered_fingerprint, sequence_hash
from ..functions.sequences import Digestion, composition, extract, header_description, header_id, illegal_residues, normalized, residue_length, reverse_and_switch, stop_stripped, upper_cased
from ..operators import build, generate, peptides, registry, summary
from ..operators.classify import capped_namespaces, contaminant_blocks, dominant_namespace, kind, labels, namespace, peel
from ..operators.formats import diagnostics, enrich
from .registry import query

TRYPSIN = Digestion(shortest=7, longest=50, missed=0)
TWO_MISSED = Digestion(shortest=7, longest=30, missed=2)

KIND = "CASE lang WHEN 'en' THEN 'target' WHEN 'de' THEN 'contaminant' WHEN 'fr' THEN 'decoy' ELSE 'entrapment' END"
SEQ = "upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'))"

#: Common table expressions of the SQL side.
PROTEINS = f"proteins AS (SELECT doc_id AS final_order, 'D' || doc_id AS id, {KIND} AS kind, source, {SEQ} AS sequence FROM documents)"
SPLIT = "list_filter(string_split(replace(regexp_replace({}, '([KR])', '\\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '')"
OCCURRENCES = f"{PROTEINS}, peps AS (SELECT id, final_order, kind, source, unnest({SPLIT.format('sequence')}) AS peptide FROM proteins), occ AS (SELECT * FROM peps WHERE length(peptide) BETWEEN 7 AND 50)"
ENTRIES = f"entries AS (SELECT source AS database_id, doc_id AS ordinal, 'D' || (doc_id // 8) AS sequence_id, {KIND} AS kind, md5({SEQ}) AS sequence_hash, lang || ' ' || source AS description_hash FROM documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    of = F.when(F.col("lang") == "en", "target").when(F.col("lang") == "de", "contaminant").when(F.col("lang") == "fr", "decoy").otherwise("entrapment")
    sequence = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    return docs.select(F.col("doc_id").alias("final_order"), F.concat(F.lit("D"), "doc_id").alias("id"), of.alias("kind"), "source", sequence.alias("sequence"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir)
    lang = F.when(F.col("kind") == "target", "en").when(F.col("kind") == "contaminant", "de").when(F.col("kind") == "decoy", "fr").otherwise("es")
    return rows.select(
        F.col("source").alias("database_id"), F.col("final_order").alias("ordinal"), F.concat(F.lit("D"), F.floor(F.col("final_order") / 8)).alias("sequence_id"), "kind",
        F.md5("sequence").alias("sequence_hash"), F.concat_ws(" ", lang, "source").alias("description_hash"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("sp|D"), "doc_id", F.lit("|X"), "doc_id", F.lit("_"), F.upper("lang"), F.lit(" text  of OS="), "source", F.lit(" OX="), "doc_id")
    return docs.select("doc_id", raw.alias("raw_header"))


HEADERS = "headers AS (SELECT doc_id, 'sp|D' || doc_id || '|X' || doc_id || '_' || upper(lang) || ' text  of OS=' || source || ' OX=' || doc_id AS raw_header FROM documents)"


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of suppliers as entries: a larger registry."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("database_id"), F.monotonically_increasing_id().alias("ordinal"), F.col("l_partkey").alias("sequence_id"), F.lit("target").alias("kind"), F.concat("l_partkey", "l_returnflag").alias("sequence_hash"), F.col("l_shipdate").cast("date").cast("string").alias("description_hash"))


PARTS = "entries AS (SELECT l_suppkey AS database_id, l_partkey AS sequence_id, 'target' AS kind, l_partkey || l_returnflag AS sequence_hash, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS description_hash FROM lineitem)"


# --- scans, headers, residues ----------------------------------------------


@query("normalize_documents", f"""
SELECT doc_id, {SEQ} AS sequence, {SEQ} <> '' AS upper_cased, true AS stop_stripped, length({SEQ}) AS residue_length, regexp_replace({SEQ}, '[ACDEFGHIKLMNPQRSTVWYXBZ]', '', 'g') AS illegal
FROM documents""")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), F.lit("*")).alias("raw"))
    rows = raw.select("doc_id", normalized(F.col("raw")).alias("sequence"), upper_cased(F.col("raw")).alias("upper_cased"), stop_stripped(F.col("raw")).alias("stop_stripped"))
    return rows.select("*", residue_length(F.col("sequence")).cast("bigint").alias("residue_length"), illegal_residues(F.col("sequence"), "ACDEFGHIKLMNPQRSTVWYXBZ").alias("illegal"))


@query("header_parse", f"""
WITH {HEADERS} SELECT doc_id, string_split(raw_header, ' ')[1] AS id, regexp_replace(substr(raw_header, instr(raw_header, ' ') + 1), '\\s+', ' ', 'g') AS description,
 regexp_extract(raw_header, '^sp\\|([^|]+)\\|', 1) AS accession, CAST(regexp_extract(raw_header, 'OX=([0-9]+)', 1) AS BIGINT) AS taxonomy_id FROM headers""")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_header")
    return headers(spark, sf_dir).select("doc_id", header_id(raw).alias("id"), header_description(raw).alias("description"), extract(r"^sp\|([^|]+)\|", raw).alias("accession"), extract("OX=([0-9]+)", raw, "integer").alias("taxonomy_id"))


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_header")
    return headers(spark, sf_dir).select("doc_id", header_id(raw).alias("id"), header_description(raw).alias("description"))


@query("format_diagnostics", "SELECT 'uniprotkb' AS format, count(*) AS matched_rows, count(*) AS total_rows, 'selected' AS status FROM documents UNION ALL SELECT 'refseq', 0, count(*), 'no_match' FROM documents")
def format_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(_frame(spark, sf_dir))


@query("enriched_headers", """
SELECT doc_id, 'uniprotkb' AS database, 'reviewed' AS review_status, 'D' || doc_id AS accession, 'X' || doc_id || '_' || upper(lang) AS entry_name, 'X' || doc_id AS entry_mnemonic,
 upper(lang) AS organism_mnemonic, 'text of' AS protein_name, source AS organism_name, doc_id AS taxonomy_id, false AS is_decoy, false AS is_contaminant, false AS is_entrapment FROM documents""")
def enriched_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich(_frame(spark, sf_dir))
    return rows.select("doc_id", "database", "review_status", "accession", "entry_name", "entry_mnemonic", "organism_mnemonic", "protein_name", "organism_name", "taxonomy_id", "is_decoy", "is_contaminant", "is_entrapment")


# --- classification --------------------------------------------------------


def _decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers with stacked decorations, from events."""
    front = F.concat(F.when(F.col("event_id") % 3 == 0, "REV_").otherwise(""), F.when(F.col("event_id") % 5 == 0, "CON__").otherwise(""), F.when(F.col("event_id") % 7 == 0, "DECOY_").otherwise(""))
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sp|A"), "user_id", F.lit("|B"), "user_id")).when(F.col("event_id") % 11 == 0, F.concat(F.lit("NX_"), "user_id")).otherwise(F.concat("event_type", F.lit("|"), "user_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(front, body).alias("id"))


DECORATED = """decorated AS (SELECT event_id, user_id, (CASE WHEN event_id % 3 = 0 THEN 'REV_' ELSE '' END) || (CASE WHEN event_id % 5 = 0 THEN 'CON__' ELSE '' END) || (CASE WHEN event_id % 7 = 0 THEN 'DECOY_' ELSE '' END) AS front,
 CASE WHEN event_id % 2 = 0 THEN 'sp|A' || user_id || '|B' || user_id WHEN event_id % 11 = 0 THEN 'NX_' || user_id ELSE event_type || '|' || user_id END AS bare FROM events),
 spaced AS (SELECT *, CASE WHEN bare LIKE 'sp|%' THEN 'uniprot' WHEN bare LIKE 'NX\\_%' ESCAPE '\\' THEN 'nextprot' WHEN regexp_matches(bare, '^[A-Za-z0-9]{1,12}\\|') THEN split_part(bare, '|', 1) || '|' ELSE 'unmatched' END AS namespace FROM decorated)"""


@query("peel_flags", f"""
WITH {DECORATED} SELECT event_id, bare, event_id % 3 = 0 OR event_id % 7 = 0 AS decoy, event_id % 5 = 0 AS contaminant,
 CASE WHEN event_id % 3 = 0 OR event_id % 7 = 0 THEN 'decoy' WHEN event_id % 5 = 0 THEN 'contaminant' ELSE 'target' END AS kind, namespace FROM spaced""")
def peel_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decorated(spark, sf_dir).withColumn("p", peel(F.col("id"))).withColumn("l", labels(F.col("p")))
    return rows.select("event_id", F.col("p.bare").alias("bare"), F.array_contains("l", "decoy").alias("decoy"), F.array_contains("l", "contaminant").alias("contaminant"), kind(F.col("l")).alias("kind"), namespace(F.col("p.bare")).alias("namespace"))


@query("namespace_counts", f"WITH {DECORATED} SELECT namespace, count(*) AS n FROM spaced GROUP BY namespace")
def namespace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _decorated(spark, sf_dir).select(namespace(peel(F.col("id"))["bare"]).alias("namespace"))
    return rows.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


def _spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decorated(spark, sf_dir).select("event_id", (F.col("user_id") % 50).alias("database_id"), F.concat(F.lit("n"), F.col("event_id") % 40).alias("namespace"))


@query("namespace_cap", """
WITH s AS (SELECT event_id, user_id % 50 AS database_id, 'n' || (event_id % 40) AS namespace FROM events), c AS (SELECT database_id, namespace, count(*) AS n, min(event_id) AS f FROM s GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY database_id ORDER BY f, namespace) AS k FROM c)
SELECT database_id, CASE WHEN k <= 5 THEN namespace ELSE 'unmatched' END AS namespace, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def namespace_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capped_namespaces(_spaced(spark, sf_dir), "database_id", "event_id", "namespace", 5)


@query("dominant_namespace", """
WITH c AS (SELECT user_id % 50 AS database_id, 'n' || (event_id % 40) AS namespace, count(*) AS n FROM events GROUP BY ALL)
SELECT database_id, namespace AS dominant_namespace FROM c QUALIFY row_number() OVER (PARTITION BY database_id ORDER BY n DESC, namespace) = 1""")
def dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _spaced(spark, sf_dir).groupBy("database_id", "namespace").agg(F.count(F.lit(1)).alias("n"))
    return dominant_namespace(counts, "database_id")


@query("marker_blocks", """
WITH e AS (SELECT user_id % 20 AS db, event_id, CASE event_id % 13 WHEN 0 THEN 'sentinel' WHEN 5 THEN 'sentinel' WHEN 7 THEN 'decoy' WHEN 9 THEN 'entrapment' WHEN 11 THEN 'contaminant' ELSE 'target' END AS kind,
  CASE WHEN event_id % 13 = 5 THEN event_type END AS marker FROM events),
 s AS (SELECT *, sum(CASE WHEN kind = 'sentinel' THEN 1 ELSE 0 END) OVER (PARTITION BY db ORDER BY event_id) AS seg FROM e),
 g AS (SELECT db, seg, max(marker) AS opened, max(CASE WHEN kind IN ('target', 'contaminant') THEN 1 ELSE 0 END) AS used FROM s GROUP BY db, seg),
 h AS (SELECT *, lag(opened) OVER w AS po, lag(used) OVER w AS pu FROM g WINDOW w AS (PARTITION BY db ORDER BY seg)),
 f AS (SELECT s.db, s.event_id, s.kind, CASE WHEN h.opened IS NULL THEN NULL WHEN h.po IS NOT NULL AND h.pu = 0 THEN 'unlabelled' ELSE h.opened END AS grp FROM s JOIN h USING (db, seg))
SELECT db, event_id, CASE WHEN kind IN ('target', 'contaminant') AND grp IS NOT NULL THEN 'contaminant' ELSE kind END AS resolved_kind,
 CASE WHEN kind IN ('target', 'contaminant') AND grp IS NOT NULL THEN grp WHEN kind = 'contaminant' THEN 'unlabelled' END AS contaminant_group FROM f""")
def marker_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("event_id") % 13
    of = F.when(m.isin(0, 5), "sentinel").when(m == 7, "decoy").when(m == 9, "entrapment").when(m == 11, "contaminant").otherwise("target")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("db"), "event_id", of.alias("kind"), F.when(m == 5, F.col("event_type")).alias("marker_group"))
    return contaminant_blocks(rows, ["db"], "event_id").select("db", "event_id", "resolved_kind", "contaminant_group")


# --- digestion and inventories ---------------------------------------------


@query("peptide_occurrences", f"WITH {OCCURRENCES} SELECT peptide, count(*) AS occurrences, count(DISTINCT id) AS proteins FROM occ GROUP BY peptide")
def peptide_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peptides.digested(proteins(spark, sf_dir), TRYPSIN, "id")
    one = rows.groupBy("peptide", "id").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("peptide").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("proteins"))


@query("digest_two_missed", f"""
WITH {PROTEINS}, runs AS (SELECT id, {SPLIT.format('sequence')} AS r FROM proteins), idx AS (SELECT id, r, unnest(range(1, len(r) + 1)) AS i FROM runs),
 m AS (SELECT id, r, i, unnest([0, 1, 2]) AS missed FROM idx), p AS (SELECT id, array_to_string(r[i:i + missed], '') AS peptide, missed FROM m WHERE i + missed <= len(r))
SELECT id, peptide, CAST(missed AS BIGINT) AS missed_cleavages FROM p WHERE length(peptide) BETWEEN 7 AND 30""")
def digest_two_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peptides.digested(proteins(spark, sf_dir), TWO_MISSED, "id")


@query("peptide_inventory", f"""
WITH {OCCURRENCES}, one AS (SELECT DISTINCT peptide, id, kind FROM occ)
SELECT peptide AS sequence, length(peptide) AS length, 0 AS missed_cleavages, count(*) AS mapping_count, count(*) AS protein_count, count(*) FILTER (kind = 'target') AS target_count,
 count(*) FILTER (kind = 'contaminant') AS contaminant_count, count(*) FILTER (kind = 'entrapment') AS entrapment_count, count(*) FILTER (kind = 'decoy') AS decoy_count FROM one GROUP BY peptide""")
def peptide_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peptides.inventory(peptides.protein_peptides(proteins(spark, sf_dir), TRYPSIN))


@query("protein_peptide_map", f"WITH {OCCURRENCES} SELECT peptide, id AS protein_id, min(final_order) AS protein_order, kind AS protein_kind, CAST(0 AS BIGINT) AS missed_cleavages FROM occ GROUP BY peptide, id, kind")
def protein_peptide_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peptides.protein_peptides(proteins(spark, sf_dir), TRYPSIN)


@query("peptide_comparison", f"""
WITH {OCCURRENCES}, a AS (SELECT DISTINCT peptide, kind FROM occ WHERE final_order % 2 = 0), b AS (SELECT DISTINCT peptide, kind FROM occ WHERE final_order % 2 = 1),
 pop AS (SELECT unnest(['all', 'target', 'contaminant', 'entrapment', 'decoy']) AS population),
 pa AS (SELECT DISTINCT population, peptide FROM pop, a WHERE population = 'all' OR population = kind), pb AS (SELECT DISTINCT population, peptide FROM pop, b WHERE population = 'all' OR population = kind),
 c AS (SELECT population, (SELECT count(*) FROM pa WHERE pa.population = pop.population) AS na, (SELECT count(*) FROM pb WHERE pb.population = pop.population) AS nb,
  (SELECT count(*) FROM pa JOIN pb USING (population, peptide) WHERE population = pop.population) AS s FROM pop)
SELECT population, na AS distinct_peptides_a, nb AS distinct_peptides_b, s AS shared_peptides, round(coalesce(s / nullif(na + nb - s, 0), 0.0), 9) AS jaccard, round(coalesce(s / nullif(na, 0), 0.0), 9) AS coverage_a_by_b,
 round(coalesce(s / nullif(nb, 0), 0.0), 9) AS coverage_b_by_a, round(coalesce(s / nullif(least(na, nb), 0), 0.0), 9) AS containment FROM c""")
def peptide_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir)
    a, b = (peptides.inventory(peptides.protein_peptides(rows.where(F.col("final_order") % 2 == k), TRYPSIN)) for k in (0, 1))
    out = peptides.compare(a, b)
    return out.withColumns({c: F.round(c, 9) for c in ("jaccard", "coverage_a_by_b", "coverage_b_by_a", "containment")})


@query("peptide_deciles_exclusive", f"""
WITH {OCCURRENCES}, l AS (SELECT CAST(length(peptide) AS DOUBLE) AS x, row_number() OVER (ORDER BY length(peptide)) - 1 AS k, count(*) OVER () AS n FROM occ),
 d AS (SELECT i, n, greatest(1, least(n - 1, i * (n + 1) // 10)) AS j FROM (SELECT DISTINCT n FROM l), (SELECT unnest([1, 5, 9]) AS i)),
 v AS (SELECT i, (a.x * (10 - (i * (d.n + 1) - j * 10)) + b.x * (i * (d.n + 1) - j * 10)) / 10 AS q FROM d JOIN l a ON a.k = j - 1 JOIN l b ON b.k = j)
SELECT max(q) FILTER (i = 1) AS length_p10, max(q) FILTER (i = 5) AS length_median, max(q) FILTER (i = 9) AS length_p90 FROM v""")
def peptide_deciles_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peptides.digested(proteins(spark, sf_dir), TRYPSIN)
    return peptides.exclusive_deciles(rows.groupBy(F.length("peptide").alias("length")).agg(F.count(F.lit(1)).alias("n")))


@query("peptide_population", f"WITH {OCCURRENCES}, c AS (SELECT peptide, count(*) AS n FROM occ GROUP BY peptide) SELECT (SELECT count(*) FROM documents) AS proteins, CAST(sum(n) AS BIGINT) AS peptides, count(*) AS unique_peptides, count(*) FILTER (n > 1) AS repeated_peptides FROM c")
def peptide_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peptides.population(proteins(spark, sf_dir), TRYPSIN).select("proteins", "peptides", "unique_peptides", "repeated_peptides")


# --- summaries and properties ----------------------------------------------


@query("length_summary", f"WITH {PROTEINS}, l AS (SELECT length(sequence) AS n FROM proteins) SELECT count(*) AS sequences, CAST(sum(n) AS BIGINT) AS total_residues, min(n) AS min_length, max(n) AS max_length, round(avg(n), 9) AS mean_length, quantile_cont(n, 0.25) AS length_q1, quantile_cont(n, 0.5) AS length_median, quantile_cont(n, 0.75) AS length_q3 FROM l")
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.length_summary(proteins(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 9))


@query("residue_composition", f"WITH {PROTEINS} SELECT residue, count(*) AS n FROM (SELECT unnest(string_split(sequence, '')) AS residue FROM proteins) WHERE residue <> '' GROUP BY residue")
def residue_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.residue_counts(proteins(spark, sf_dir))


def _scale_sql(scale: dict[str, float]) -> str:
    return " + ".join(f"(length(peptide) - length(replace(peptide, '{r}', ''))) * CAST({v} AS DOUBLE)" for r, v in sorted(scale.items()))


def _charge_sql(scale: props.PkScale, ph: float) -> str:
    n = lambda r: f"(length(peptide) - length(replace(peptide, '{r}', '')))"
    gains = " + ".join(f"{n(r)} / (1 + pow(10.0, {ph} - {pk}))" for r, pk in scale.gains.items())
    losses = " - ".join(f"{n(r)} / (1 + pow(10.0, {pk} - {ph}))" for r, pk in scale.losses.items())
    return f"1 / (1 + pow(10.0, {ph} - {scale.n_end})) + {gains} - 1 / (1 + pow(10.0, {scale.c_end} - {ph})) - {losses}"


_STANDARD = f"WITH {OCCURRENCES}, d AS (SELECT DISTINCT peptide FROM occ WHERE regexp_full_match(peptide, '[{props.STANDARD}]+'))"
_DIPEPTIDES = ", ".join(f"('{d}', CAST({w} AS DOUBLE))" for w, ds in props.INSTABILITY.items() for d in ds.split())


@query("peptide_properties", f"""
{_STANDARD} SELECT peptide, length(peptide) AS length, round({_scale_sql(props.MASS)} + {props.WATER}, 6) + 0.0 AS molecular_weight, round(({_scale_sql(props.HYDROPATHY)}) / length(peptide), 6) + 0.0 AS hydrophobicity,
 round(-({_scale_sql(props.BOMAN)}) / length(peptide), 6) + 0.0 AS boman_index, round({_charge_sql(props.SILLERO, 7.0)}, 6) + 0.0 AS charge,
 round(({_scale_sql(props.RETENTION)}) * (1 - 0.21 * ln(length(peptide))) + {props.RETENTION_SHIFT}, 6) + 0.0 AS predicted_retention_time,
 length(peptide) - length(replace(peptide, 'P', '')) AS proline_count, right(peptide, 1) AS c_terminal_residue, contains(peptide, 'C') AS contains_cysteine, contains(peptide, 'NG') AS contains_ng_motif FROM d""")
def peptide_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = props.property_frame(_distinct_standard(spark, sf_dir), "peptide")
    rounded = {c: (F.round(c, 6) + F.lit(0.0)) for c in ("molecular_weight", "hydrophobicity", "boman_index", "charge", "predicted_retention_time")}
    return rows.select("peptide", "length", *list(rounded), "proline_count", "c_terminal_residue", "contains_cysteine", "contains_ng_motif").withColumns(rounded)


def _distinct_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peptides.digested(proteins(spark, sf_dir), TRYPSIN).select("peptide").distinct()
    return rows.where(F.col("peptide").rlike(f"^[{props.STANDARD}]+$"))


@query("instability_index", f"""
{_STANDARD}, w(dipeptide, weight) AS (VALUES {_DIPEPTIDES}), p AS (SELECT peptide, unnest(range(1, length(peptide))) AS i FROM d)
SELECT peptide, round(10.0 / length(peptide) * sum(coalesce(weight, 1.0)), 6) AS instability_index FROM p LEFT JOIN w ON substr(peptide, i, 2) = dipeptide GROUP BY peptide""")
def instability_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_standard(spark, sf_dir).select("peptide", F.round(props.instability_index(F.col("peptide")), 6).alias("instability_index"))


_EMBOSS_SQL = _charge_sql(props.EMBOSS, 0).replace("0 - ", "((low + high) / 2) - ").replace(" - 0)", " - ((low + high) / 2))")


@query("isoelectric_point", f"""
{_STANDARD}, b AS (SELECT peptide, 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(14 AS DOUBLE) AS high FROM d), r AS (WITH RECURSIVE s AS (
 SELECT * FROM b UNION ALL SELECT peptide, step + 1, CASE WHEN c > 0 THEN (low + high) / 2 ELSE low END, CASE WHEN c > 0 THEN high ELSE (low + high) / 2 END FROM (SELECT *, {_EMBOSS_SQL} AS c FROM s WHERE step < 34)) SELECT * FROM s WHERE step = 34)
SELECT peptide, round((low + high) / 2, 5) AS isoelectric_point FROM r""")
def isoelectric_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_standard(spark, sf_dir).select("peptide", F.round(props.isoelectric_point(F.col("peptide")), 5).alias("isoelectric_point"))


@query("blake2b_hashes")
def blake2b_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).select("id", F.lower(F.hex(sequence_hash(F.col("sequence")))).alias("sequence_hash"))


@query("id_fingerprints")
def id_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordered_fingerprint(entries(spark, sf_dir), ["database_id", "kind"], ["sequence_id"])
    return rows.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


# --- generation ------------------------------------------------------------


@query("decoy_reverse", f"WITH {PROTEINS} SELECT final_order, 'REV_' || id AS raw_header, reverse(sequence) AS sequence FROM proteins")
def decoy_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir).select("final_order", F.col("id").alias("raw_header"), "sequence")
    return generate.reverse_decoys(rows)


@query("decoy_shared_peptides", f"""
WITH {OCCURRENCES}, rd AS (SELECT unnest({SPLIT.format('reverse(sequence)')}) AS peptide FROM proteins)
SELECT count(DISTINCT rd.peptide) AS collisions FROM rd JOIN (SELECT DISTINCT peptide FROM occ) t USING (peptide)""")
def decoy_shared_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir).select(F.col("id").alias("raw_header"), "sequence")
    return generate.collisions(generate.reverse_decoys(rows), rows, TRYPSIN)


@query("decoy_statistics", f"""
WITH {OCCURRENCES}, rd AS (SELECT unnest({SPLIT.format('reverse(sequence)')}) AS peptide FROM proteins), d AS (SELECT DISTINCT peptide FROM rd WHERE length(peptide) BETWEEN 7 AND 50), t AS (SELECT DISTINCT peptide FROM occ),
 k AS (SELECT DISTINCT array_to_string(list_sort(string_split(peptide, '')), '') AS key FROM t)
SELECT round((SELECT count(*) FROM d) / (SELECT count(*) FROM t), 9) AS unique_ratio, (SELECT count(*) FROM d JOIN t USING (peptide)) AS shared_with_targets,
 round((SELECT count(*) FROM d JOIN k ON array_to_string(list_sort(string_split(d.peptide, '')), '') = k.key) / (SELECT count(*) FROM d), 9) AS composition_overlap""")
def decoy_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir).select(F.col("id").alias("raw_header"), "sequence")
    found = peptides.decoy_statistics(generate.reverse_decoys(rows), rows, TRYPSIN)
    return found.withColumns({c: F.round(c, 9) for c in ("unique_ratio", "composition_overlap")})


@query("peptide_compositions", f"WITH {OCCURRENCES} SELECT array_to_string(list_sort(string_split(peptide, '')), '') AS composition, count(*) AS n FROM occ GROUP BY 1")
def peptide_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = peptides.digested(proteins(spark, sf_dir), TRYPSIN)
    return rows.groupBy(composition(F.col("peptide")).alias("composition")).agg(F.count(F.lit(1)).alias("n"))


#: Of the reversed peptide, a run of cleavage residues passes the residue before it (at the start, the rest of a run its first one).
_SWITCHED = "regexp_replace(reverse(peptide), '(^[KR]|[^KR])([KR]+)', '\\2\\1', 'g')"


@query("reverse_and_switch", f"WITH {OCCURRENCES} SELECT id, peptide, {_SWITCHED} AS decoy FROM occ")
def reversed_and_switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peptides.digested(proteins(spark, sf_dir), TRYPSIN, "id").select("id", "peptide", reverse_and_switch(F.col("peptide")).alias("decoy"))


@query("decoypyrat")
def decoypyrat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.decoypyrat(proteins(spark, sf_dir).select("id", F.col("id").alias("raw_header"), "sequence"), TRYPSIN, 7)


@query("shuffle_decoys")
def shuffle_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.shuffle_decoys(proteins(spark, sf_dir).select(F.col("id").alias("raw_header"), "sequence"), 7)


@query("shuffled_entrapment")
def shuffled_entrapment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.shuffled_entrapment(proteins(spark, sf_dir).select("id", F.col("id").alias("raw_header"), "sequence"), TRYPSIN, 1, 7)


@query("foreign_rejection", f"""
WITH {OCCURRENCES}, t AS (SELECT DISTINCT peptide FROM occ WHERE kind = 'target'), bad AS (SELECT DISTINCT id FROM occ JOIN t USING (peptide) WHERE kind = 'entrapment')
SELECT id FROM proteins WHERE kind = 'entrapment' AND id NOT IN (SELECT id FROM bad)""")
def foreign_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir)
    return generate.foreign_entrapment(rows.where("kind = 'target'"), rows.where("kind = 'entrapment'"), TRYPSIN, 2**31 - 1, 7).select("id")


# --- assembly --------------------------------------------------------------


@query("dedupe_first_wins", "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return build.first_wins(rows, key="o_custkey", order=["o_orderdate", "o_orderkey"], conflict=None).drop("o_orderdate")


@query("combined_ordinal", "SELECT source AS database_id, doc_id AS ordinal, row_number() OVER (ORDER BY source, doc_id) - 1 AS combined_ordinal FROM documents")
def combined_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.combined_ordinals(entries(spark, sf_dir).select("database_id", "ordinal")).select("database_id", "ordinal", F.col("combined_ordinal").cast("bigint").alias("combined_ordinal"))


@query("assembled_inventory", f"""
WITH {PROTEINS}, u AS (SELECT 0 AS g, * FROM proteins WHERE kind = 'target' UNION ALL SELECT 1, * FROM proteins WHERE kind = 'contaminant')
SELECT id, kind, row_number() OVER (ORDER BY g, final_order) - 1 AS final_order FROM u""")
def assembled_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proteins(spark, sf_dir).withColumnRenamed("final_order", "record_order").drop("source")
    groups = [(k, rows.where(F.col("kind") == k).drop("kind")) for k in ("target", "contaminant")]
    return build.assembled(groups, ["record_order"]).select("id", "kind", "final_order")


# --- registry --------------------------------------------------------------

_BATTERY = """SELECT database_id, kind, count(*) AS entries, count(DISTINCT sequence_id) AS distinct_ids, count(DISTINCT sequence_hash) AS distinct_sequences, count(DISTINCT description_hash) AS distinct_descriptions,
 count(DISTINCT (sequence_id, sequence_hash)) AS distinct_pairs, count(*) - count(DISTINCT sequence_id) AS duplicate_occurrences FROM entries GROUP BY database_id, kind"""


def _battery_sql(source: str) -> str:
    return f"""WITH {source}, b AS ({_BATTERY}), c AS (SELECT database_id, kind, count(*) AS conflicting_ids FROM (SELECT database_id, kind, sequence_id FROM entries GROUP BY ALL HAVING count(DISTINCT sequence_hash) > 1) GROUP BY ALL),
 r AS (SELECT database_id, kind, count(*) AS repeated_sequences FROM (SELECT database_id, kind, sequence_hash FROM entries GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)
SELECT b.*, coalesce(conflicting_ids, 0) AS conflicting_ids, coalesce(repeated_sequences, 0) AS repeated_sequences FROM b LEFT JOIN c USING (database_id, kind) LEFT JOIN r USING (database_id, kind)"""


@query("entry_battery", _battery_sql(ENTRIES))
def entry_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.kind_stats(entries(spark, sf_dir))


@query("part_battery", _battery_sql(PARTS))
def part_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.kind_stats(parts(spark, sf_dir))


def _shared_sql(source: str, column: str, name: str) -> str:
    return f"WITH {source}, d AS (SELECT DISTINCT database_id, kind, {column} AS v FROM entries WHERE {column} IS NOT NULL) SELECT a.kind, a.database_id AS low, b.database_id AS high, count(*) AS {name} FROM d a JOIN d b ON a.kind = b.kind AND a.v = b.v AND a.database_id < b.database_id GROUP BY ALL"


@query("pair_shared_ids", _shared_sql(ENTRIES, "sequence_id", "shared_ids"))
def pair_shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.shared_counts(entries(spark, sf_dir), ["sequence_id"], "shared_ids")


@query("pair_shared_sequences", _shared_sql(ENTRIES, "sequence_hash", "shared_sequences"))
def pair_shared_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.shared_counts(entries(spark, sf_dir), ["sequence_hash"], "shared_sequences")


@query("pair_shared_descriptions", _shared_sql(PARTS, "description_hash", "shared_descriptions"))
def pair_shared_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.shared_counts(parts(spark, sf_dir), ["description_hash"], "shared_descriptions")


@query("pair_shared_parts", _shared_sql(PARTS, "sequence_id", "shared_ids"))
def pair_shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.shared_counts(parts(spark, sf_dir), ["sequence_id"], "shared_ids")


@query("pair_exact", f"""
WITH {ENTRIES}, d AS (SELECT DISTINCT database_id, kind, sequence_id, sequence_hash FROM entries)
SELECT a.kind, a.database_id AS low, b.database_id AS high, count(*) AS shared_exact_pairs, count(DISTINCT a.sequence_id) AS matching_shared_ids
FROM d a JOIN d b ON a.kind = b.kind AND a.sequence_id = b.sequence_id AND a.sequence_hash = b.sequence_hash AND a.database_id < b.database_id GROUP BY ALL""")
def pair_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.matching_ids(entries(spark, sf_dir))


_STATS = f"{ENTRIES}, stats AS ({_BATTERY})"
_SHARED = "shared AS (SELECT a.kind, a.database_id AS low, b.database_id AS high, count(*) AS n FROM (SELECT DISTINCT database_id, kind, sequence_id FROM entries) a JOIN (SELECT DISTINCT database_id, kind, sequence_id FROM entries) b ON a.kind = b.kind AND a.sequence_id = b.sequence_id AND a.database_id < b.database_id GROUP BY ALL)"
_GRID = "dbs AS (SELECT DISTINCT database_id FROM entries), grid AS (SELECT k.kind, a.database_id AS low, b.database_id AS high FROM dbs a JOIN dbs b ON a.database_id < b.database_id, (SELECT unnest(['target', 'contaminant']) AS kind) k)"
_SIMILAR = f"""WITH {_STATS}, {_SHARED}, {_GRID}, sim AS (SELECT g.kind, g.low, g.high, coalesce(s.n, 0) AS shared_ids, coalesce(x.distinct_ids, 0) AS a, coalesce(y.distinct_ids, 0) AS b FROM grid g LEFT JOIN shared s USING (kind, low, high)
 LEFT JOIN stats x ON x.kind = g.kind AND x.database_id = g.low LEFT JOIN stats y ON y.kind = g.kind AND y.database_id = g.high)"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return registry.similarities(registry.pair_stats(rows), registry.kind_stats(rows))


@query("pair_similarity_ratios", f"""{_SIMILAR} SELECT kind, low, high, shared_ids, round(coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0), 9) AS id_jaccard, round(coalesce(shared_ids / nullif(least(a, b), 0), 0.0), 9) AS id_containment,
 shared_ids > 0 AND shared_ids = a AS id_low_in_high, shared_ids > 0 AND shared_ids = a AND shared_ids = b AS exact_id_set FROM sim""")
def pair_similarity_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).select("kind", "low", "high", "shared_ids", F.round("id_jaccard", 9).alias("id_jaccard"), F.round("id_containment", 9).alias("id_containment"), "id_low_in_high", "exact_id_set")


@query("nearest_neighbours", f"""{_SIMILAR}, n AS (SELECT kind, low AS database_id, high AS neighbour, coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0) AS score FROM sim UNION ALL SELECT kind, high, low, coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0) FROM sim)
SELECT kind, database_id, neighbour, round(score, 9) AS score, row_number() OVER (PARTITION BY kind, database_id ORDER BY score DESC, neighbour) AS rank FROM n QUALIFY rank <= 5""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.neighbours(_similar(spark, sf_dir), limit=5).withColumn("score", F.round("score", 9))


@query("relationship_labels", f"""{_SIMILAR}, o AS (SELECT kind, CASE WHEN low = 'src0' THEN high ELSE low END AS database_id, CASE WHEN low = 'src0' THEN a ELSE b END AS sel, CASE WHEN low = 'src0' THEN b ELSE a END AS oth, shared_ids FROM sim WHERE 'src0' IN (low, high))
SELECT kind, database_id, shared_ids, sel - shared_ids AS selected_only_ids, oth - shared_ids AS other_only_ids, CASE WHEN shared_ids > 0 AND shared_ids = sel AND shared_ids = oth THEN 'exact_id_set' WHEN shared_ids > 0 AND shared_ids = sel AND sel < oth THEN 'subset'
 WHEN shared_ids > 0 AND shared_ids = oth AND oth < sel THEN 'superset' WHEN shared_ids > 0 AND shared_ids / least(sel, oth) >= 0.99 THEN 'near_match' WHEN shared_ids > 0 THEN 'partial_overlap' ELSE 'no_overlap' END AS relationship FROM o""")
def relationship_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.comparisons(_similar(spark, sf_dir), "src0").select("kind", "database_id", "shared_ids", "selected_only_ids", "other_only_ids", "relationship")


def _ranking_sql() -> str:
    counts = {"ids": "sequence_id", "sequences": "sequence_hash", "descriptions": "description_hash"}
    own = ", ".join(f"count(DISTINCT {c}) AS {n}" for n, c in counts.items())
    shared = ", ".join(f"(SELECT count(DISTINCT a.{c}) FROM e a JOIN e b ON b.database_id = 'src0' AND a.kind = b.kind AND a.{c} = b.{c} WHERE a.kind = k.kind AND a.database_id = k.database_id) AS shared_{n}" for n, c in counts.items())
    return f"""WITH {ENTRIES}, e AS (SELECT DISTINCT database_id, kind, sequence_id, sequence_hash, description_hash FROM entries), o AS (SELECT database_id, kind, {own}, count(DISTINCT (sequence_id, sequence_hash)) AS pairs FROM e GROUP BY ALL),
 g AS (SELECT d.database_id, k.kind FROM (SELECT DISTINCT database_id FROM e WHERE database_id <> 'src0') d, (SELECT unnest(['target', 'contaminant']) AS kind) k),
 x AS (SELECT k.kind, k.database_id, {shared}, (SELECT count(*) FROM (SELECT DISTINCT a.sequence_id, a.sequence_hash FROM e a JOIN e b ON b.database_id = 'src0' AND a.kind = b.kind AND a.sequence_id = b.sequence_id AND a.sequence_hash = b.sequence_hash WHERE a.kind = k.kind AND a.database_id = k.database_id)) AS exact FROM g k),
 c AS (SELECT x.*, coalesce(s.ids, 0) AS si, coalesce(t.ids, 0) AS ti, coalesce(s.descriptions, 0) AS sd, coalesce(t.descriptions, 0) AS td, coalesce(s.pairs, 0) AS sp, coalesce(t.pairs, 0) AS tp FROM x LEFT JOIN o s ON s.database_id = 'src0' AND s.kind = x.kind LEFT JOIN o t ON t.database_id = x.database_id AND t.kind = x.kind),
 r AS (SELECT *, coalesce(shared_ids / nullif(least(si, ti), 0), 0.0) AS near, coalesce(shared_ids / nullif(si + ti - shared_ids, 0), 0.0) AS jac, coalesce(shared_descriptions / nullif(sd + td - shared_descriptions, 0), 0.0) AS words,
  exact > 0 AND exact = sp AND exact = tp AS same, shared_ids > 0 AND shared_ids = si AND shared_ids = ti AS same_ids FROM c)
SELECT kind, database_id, CASE WHEN same THEN 'exact_content' WHEN same_ids THEN 'exact_id_set' WHEN shared_ids > 0 AND shared_ids = si AND si < ti THEN 'subset' WHEN shared_ids > 0 AND shared_ids = ti AND ti < si THEN 'superset'
 WHEN shared_ids > 0 AND near >= 0.99 THEN 'near_match' WHEN shared_ids > 0 THEN 'partial_overlap' ELSE 'no_overlap' END AS relationship,
 row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN same THEN 0 WHEN same_ids THEN 1 WHEN shared_ids > 0 AND near >= 0.99 THEN 2 WHEN shared_ids > 0 THEN 3 WHEN shared_sequences > 0 THEN 4 ELSE 5 END,
  near DESC, jac DESC, shared_ids DESC, shared_sequences DESC, words DESC, shared_descriptions DESC, lower(database_id), database_id) AS rank FROM r"""


@query("comparison_ranking", _ranking_sql())
def comparison_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.comparisons(_similar(spark, sf_dir), "src0").select("kind", "database_id", "relationship", "rank")


@query("best_overlap", f"""{_SIMILAR} SELECT CASE WHEN low = 'src0' THEN high ELSE low END AS database_id, shared_ids, round(coalesce(shared_ids / nullif(least(a, b), 0), 0.0), 9) AS id_containment FROM sim WHERE kind = 'target' AND 'src0' IN (low, high)
ORDER BY coalesce(shared_ids / nullif(least(a, b), 0), 0.0) DESC, coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0) DESC, shared_ids DESC, database_id LIMIT 1""")
def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.best_overlap(_similar(spark, sf_dir).where("kind = 'target'"), "src0", 0.0).select("database_id", "shared_ids", F.round("id_containment", 9).alias("id_containment"))


@query("content_groups", f"""
WITH {ENTRIES}, p AS (SELECT DISTINCT database_id, kind, sequence_id, sequence_hash FROM entries), g AS (SELECT database_id, kind, md5(string_agg(sequence_id || '/' || sequence_hash, ',' ORDER BY sequence_id, sequence_hash)) AS f, count(*) AS pairs FROM p GROUP BY ALL)
SELECT kind, min(database_id) AS representative, pairs, count(*) AS members FROM g GROUP BY kind, f, pairs""")
def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.content_groups(entries(spark, sf_dir))


@query("candidate_counts", f"""
WITH {ENTRIES}, c AS (SELECT DISTINCT kind, sequence_id FROM entries WHERE database_id = 'src0'), h AS (SELECT DISTINCT kind, sequence_hash FROM entries WHERE database_id = 'src0'), d AS (SELECT DISTINCT kind, description_hash FROM entries WHERE database_id = 'src0'),
 x AS (SELECT DISTINCT kind, sequence_id, sequence_hash FROM entries WHERE database_id = 'src0'), e AS (SELECT DISTINCT database_id, kind, sequence_id, sequence_hash, description_hash FROM entries)
SELECT * FROM (SELECT database_id, kind, (SELECT count(DISTINCT sequence_id) FROM e JOIN c USING (kind, sequence_id) WHERE e.database_id = k.database_id AND e.kind = k.kind) AS shared_ids,
 (SELECT count(DISTINCT sequence_hash) FROM e JOIN h USING (kind, sequence_hash) WHERE e.database_id = k.database_id AND e.kind = k.kind) AS shared_sequences,
 (SELECT count(DISTINCT description_hash) FROM e JOIN d USING (kind, description_hash) WHERE e.database_id = k.database_id AND e.kind = k.kind) AS shared_descriptions,
 (SELECT count(DISTINCT (sequence_id, sequence_hash)) FROM e JOIN x USING (kind, sequence_id, sequence_hash) WHERE e.database_id = k.database_id AND e.kind = k.kind) AS shared_exact_pairs,
 (SELECT count(DISTINCT sequence_id) FROM e JOIN x USING (kind, sequence_id, sequence_hash) WHERE e.database_id = k.database_id AND e.kind = k.kind) AS matching_shared_ids
 FROM (SELECT DISTINCT database_id, kind FROM entries) k) WHERE shared_ids + shared_sequences + shared_descriptions > 0""")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return registry.candidate_counts(rows.where("database_id = 'src0'"), rows)


@query("orphan_check", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("database_id"), "o_orderkey")
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("database_id"))
    return registry.orphans(rows, known).select("o_orderkey")


@query("duplicated_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.duplicated_keys(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("cluster_merges")
def cluster_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.average_linkage(_similar(spark, sf_dir))


_DATABASES = sorted(f"src{k}" for k in range(20))


@query("jaccard_matrix", f"""{_SIMILAR}, m AS (SELECT low AS r, high AS c, round(coalesce(shared_ids / nullif(a + b - shared_ids, 0), 0.0), 9) AS v FROM sim WHERE kind = 'target'),
 f AS (SELECT r, c, v FROM m UNION ALL SELECT c, r, v FROM m UNION ALL SELECT database_id, database_id, 1.0 FROM dbs)
SELECT r AS row, {", ".join(f"max(v) FILTER (c = '{d}') AS {d}" for d in _DATABASES)} FROM f GROUP BY r""")
def jaccard_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.jaccard_matrix(_similar(spark, sf_dir), "target", _DATABASES)
    return rows.select("row", *[F.round(d, 9).alias(d) for d in _DATABASES])
