"""Queries by inventory id that write files and read them back, and the small checks around a load."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import consensus, guards, ingest, intervals, ledger, lifecycle
from helixframe.operators.store import Store
from helixframe.plans import views
from helixframe.plans.catalog import DISC, SQL, c, plan, resolved_of
from helixframe.plans.catalog_more import _KEY, EXPORT, NORM, REGION, VCF, exported, stage
from helixframe.session import Scratch
from helixframe.sources import blockgzip, files, jsonarray, vcf


def folder(t) -> str:
    """A new folder that driver and executors share."""
    return f"{Scratch(spark_of(t)).root}/files"


def spark_of(t):
    return t("region").sparkSession


# scans and sinks

CPIC = "guideline_id long, gene_symbol string, drug_name string, phenotype string"


def cpic_array(t) -> DataFrame:
    """All guidelines as one JSON array in one file, read back in stretches of 64 KB."""
    path = f"{folder(t)}/cpic.json"
    jsonarray.write(t("s_cpic").select("guideline_id", "gene_symbol", "drug_name", "phenotype"), path)
    return jsonarray.read(spark_of(t), path, CPIC, stretch=1 << 16)


plan("S11", "SELECT guideline_id, gene_symbol, drug_name, phenotype FROM s_cpic")(cpic_array)

RUNS = "rg AS (SELECT chrom, pos_grch38, sum(b) OVER (PARTITION BY chrom ORDER BY pos_grch38) AS k FROM (SELECT *, coalesce((pos_grch38 - lag(pos_grch38) OVER (PARTITION BY chrom ORDER BY pos_grch38) > 150)::INT, 1) AS b FROM (SELECT DISTINCT chrom, pos_grch38 FROM s_gnomad WHERE af_global < 0.01))), rr AS (SELECT chrom, min(pos_grch38) AS s, max(pos_grch38) AS e FROM rg GROUP BY chrom, k)"


def by_regions(t) -> DataFrame:
    """VCF records in the coalesced regions of rare positions, from block-gzip files by their index; a region is read once, so no record comes twice."""
    spark, scratch = spark_of(t), Scratch(spark_of(t))
    regions = scratch.save(intervals.coalesce_positions(t("s_gnomad").filter("af_global < 0.01"), 150).select("chrom", "start", "end"), "regions")
    lines = t("s_vcf").withColumn("f", F.split("value", "\t")).select(F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("pos"), "line_no", "value")
    made = blockgzip.write(lines, f"{scratch.root}/vcf", "chrom", ["pos", "line_no"], "value", {x: vcf.header(x, "SAMPLE") for x in vcf.LENGTHS}, {})
    index = scratch.save(blockgzip.index(spark, [f"{scratch.root}/vcf/{x}.vcf.gz" for x in made["files"]]), "index")
    return vcf.records(blockgzip.in_regions(index, regions).select("value")).select("chrom", "pos", "id")


plan("S15", VCF + f", {RUNS} SELECT r.chrom, r.pos, r.id FROM r JOIN rr ON rr.chrom = r.chrom AND r.pos BETWEEN rr.s AND rr.e")(by_regions)


def staged(t) -> tuple[str, DataFrame]:
    path = folder(t)
    files.write_partitions(t("s_gnomad"), path)
    return path, t("s_gnomad").sparkSession.read.parquet(path)


plan("S18", "SELECT freq_id, chrom, pos_grch38, af_global FROM s_gnomad WHERE chrom = 'X'")(lambda t: files.read_partition(spark_of(t), staged(t)[0], "X").select("freq_id", "chrom", "pos_grch38", "af_global"))
plan("S23", "SELECT chrom, count(*) AS n, min(pos_grch38) AS first, max(pos_grch38) AS last FROM s_gnomad GROUP BY 1")(lambda t: staged(t)[1].groupBy(c("chrom").cast("string").alias("chrom")).agg(F.count("*").alias("n"), F.min("pos_grch38").alias("first"), F.max("pos_grch38").alias("last")))


def written(t, write, rows: DataFrame, by: str) -> DataFrame:
    """All lines of the files that were written, header and records, with the name of their file."""
    path = folder(t)
    write(rows, path, "SAMPLE", panel="1000g")
    name = F.regexp_extract(F.input_file_name(), "([^/]+)\\.vcf\\.gz$", 1)
    return spark_of(t).read.text(f"{path}/*.vcf.gz").select(name.alias(by), c("value").alias("line"))


def headed(by: str, ids: str) -> str:
    """SQL of the header lines of each value that ids selects, as (value, chromosome)."""
    fixed = ["##fileformat=VCFv4.2", "##source=helixframe", "##reference=GRCh38", '##INFO=<ID=.,Number=0,Type=Flag,Description="No INFO emitted">', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tSAMPLE"]
    texts = ", ".join("'" + x + "'" for x in fixed)
    lengths = "map {" + ", ".join(f"'{k}': {v}" for k, v in vcf.LENGTHS.items()) + "}"
    return f"SELECT k AS {by}, unnest([{texts}, '##contig=<ID=chr' || x || ',length=' || {lengths}[x] || ',assembly=GRCh38>']) AS line FROM ({ids}) AS ids(k, x)"


plan("S20", EXPORT + " SELECT chrom, line FROM ex UNION ALL " + headed("chrom", "SELECT DISTINCT chrom, chrom FROM ex"))(lambda t: written(t, vcf.write_chromosomes, exported(t), "chrom"))
plan("S21", EXPORT + f", rg AS (SELECT {REGION} AS region, CASE WHEN {REGION} = 'nonPAR' THEN CASE WHEN line LIKE '%0/0' THEN left(line, len(line) - 3) || '0' WHEN line LIKE '%1/1' THEN left(line, len(line) - 3) || '1' ELSE left(line, len(line) - 3) || '.' END ELSE line END AS line FROM ex WHERE chrom = 'X') SELECT * FROM rg UNION ALL " + headed("region", "SELECT DISTINCT region, 'X' FROM rg"))(
    lambda t: written(t, vcf.write_regions, vcf.region_rows(exported(t), True), "region")
)


def manifest_of(t) -> DataFrame:
    """The manifest of an export as it stands in its file."""
    path = folder(t)
    vcf.write_chromosomes(exported(t), path, "SAMPLE", panel="1000g", input_run_ids=[1, 2])
    shape = "struct<build string, compression string, files array<string>, input_run_ids array<long>, panel string, records map<string, long>, sample_id string, total long>"
    told = spark_of(t).read.text(f"{path}/manifest.json", wholetext=True).select(F.from_json("value", shape).alias("m")).select("m.*")
    return told.select("build", "compression", "panel", "sample_id", "input_run_ids", "total", F.array_join("files", ",").alias("files"), F.explode("records").alias("chrom", "n"))


plan("S22", EXPORT + " SELECT 'GRCh38' AS build, 'bgzip' AS compression, '1000g' AS panel, 'SAMPLE' AS sample_id, [1, 2]::BIGINT[] AS input_run_ids, (SELECT count(*) FROM ex) AS total, (SELECT string_agg(DISTINCT chrom, ',' ORDER BY chrom) FROM ex) AS files, chrom, count(*) AS n FROM ex GROUP BY chrom")(manifest_of)

CALLS = ["call_id", "variant_id", "source", "allele_1", "allele_2", "is_no_call", "is_active"]


def bulk_load(t) -> DataFrame:
    """Chip calls staged in one load and appended to the calls table by one insert-select."""
    rows = files.stage(ingest.call_rows(stage(t), t("s_variants"), "23andme"), folder(t))
    return files.insert_select(t("s_calls").select(*CALLS), rows, call_id=c("variant_id") * 4)


plan("S24", NORM + f" SELECT call_id, variant_id, source, allele_1, allele_2, is_no_call, is_active FROM s_calls UNION ALL SELECT v.variant_id * 4, v.variant_id, '23andme', allele_1, allele_2, is_no_call, TRUE FROM st x JOIN s_variants v ON {_KEY}")(bulk_load)
LEDGER = "record_seq long, pr_key string, state string, knob string, delta long"


def ledger_of(t, *transitions: str) -> DataFrame:
    """The ledger's records appended to JSON lines, one write for each transition, and read back."""
    path, columns = folder(t), [x.split()[0] for x in LEDGER.split(", ")]
    for some in transitions:
        ledger.append(t("s_ledger").filter(some).select(*columns), path)
    return ledger.read(spark_of(t), path, LEDGER)


plan("S25", "SELECT record_seq, pr_key, state, knob, delta FROM s_ledger")(lambda t: ledger_of(t, "true"))
plan("S26", "SELECT state, count(*) AS n, max(record_seq) AS last FROM s_ledger GROUP BY 1")(lambda t: ledger_of(t, "state in ('pending', 'ready')", "state in ('running', 'blocked', 'parked')", "state = 'done'").groupBy("state").agg(F.count("*").alias("n"), F.max("record_seq").alias("last")))


def block_files(t) -> DataFrame:
    """Pages as block-gzip files, some without their last block, and plain ones."""
    body = F.sha2(F.coalesce("url", F.lit("")), 256)
    head = F.when(c("page_id") % 3 == 0, F.lit("1f8b0800")).otherwise(F.lit("1f8b0804"))
    end = F.when(c("page_id") % 5 == 0, F.lit("00")).otherwise(F.lit(files.END_BLOCK))
    content = F.unhex(F.concat(head, F.lit("0000000000ff060042430200"), body, end))
    return t("pages").select("page_id", files.is_block_gzip(content).alias("is_block_gzip"), files.is_truncated(content).alias("is_truncated"))


plan("S29", "SELECT page_id, page_id % 3 <> 0 AS is_block_gzip, page_id % 3 <> 0 AND page_id % 5 = 0 AS is_truncated FROM pages")(block_files)


def cached(t) -> DataFrame:
    page = t("pages").select(c("page_id").cast("string").alias("name"), F.sha2(F.coalesce("url", F.lit("")), 256).alias("digest"), c("page_id"))
    have = page.select("name", "digest", F.concat(F.lit("v"), (c("page_id") % 4).cast("string")).alias("label"), F.when(c("page_id") % 7 == 0, F.lit("other")).when(c("page_id") % 11 == 0, F.lit(None)).otherwise(c("digest")).alias("actual"))
    return files.reuse(page.select("name", F.lit("v9").alias("label")), have)


plan("S32", "SELECT CAST(page_id AS VARCHAR) AS name, CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN 'fetch' ELSE 'reuse' END AS action, CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN 'v9' ELSE 'v' || (page_id % 4) END AS label FROM pages")(cached)
TABLES = ("s_acmg", "s_calls", "s_clinvar", "s_cpic", "s_dbsnp", "s_gnomad", "s_gwas", "s_pharmgkb", "s_pgs", "s_scores", "s_variants", "s_versions")
plan("S37", " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in TABLES))(lambda t: guards.counts({x: t(x) for x in TABLES}))


def status(t) -> DataFrame:
    """Rows of the registered views, of profiles and of their settings."""
    spark = t("region").sparkSession
    views_of = guards.materialise(spark, {"hx_carrier_panel": lambda: views.carrier_panel(t("s_carrier")), "hx_active_medications": lambda: views.active_medications(t("s_medications")), "hx_pgs_extremes": lambda: views.pgs_extremes(t("s_pgs"), t("s_scores"))})
    settings = t("clients").select("client_id", F.explode(F.array("segment", F.col("nation_id").cast("string"))).alias("setting")).filter("setting is not null and client_id is not null")
    return guards.counts({**views_of, "profiles": t("clients").filter("client_id is not null").select("client_id").distinct(), "settings": settings})


plan("S37v", f"""SELECT 'hx_carrier_panel' AS name, count(*) AS n FROM ({SQL['V05']}) UNION ALL SELECT 'hx_active_medications', count(*) FROM ({SQL['K02']}) UNION ALL SELECT 'hx_pgs_extremes', count(*) FROM ({SQL['V04']})
 UNION ALL SELECT 'profiles', count(DISTINCT client_id) FROM clients UNION ALL SELECT 'settings', count(segment) FILTER (WHERE client_id IS NOT NULL) + count(nation_id) FILTER (WHERE client_id IS NOT NULL) FROM clients""")(status)

# checks and lifecycle

plan("P26", "SELECT variant_id, chrom FROM s_variants WHERE chrom IN ('2', '10', 'X')")(lambda t: guards.of_chromosomes(t("s_variants"), "chr2, x ,,10,CHRX").select("variant_id", "chrom"))


def incoming(t) -> DataFrame:
    """For each registered version, a release of the same label whose content changed for some sources."""
    hashed = t("s_registry").withColumn("digest", F.md5(F.concat("source_db", "version")))
    changed = F.when(c("source_db").isin("db1", "db4"), F.md5("version")).otherwise(c("digest"))
    return guards.unchanged(hashed.select("source_db", "version", changed.alias("digest")), hashed, t("s_live"))


plan("D04", "SELECT v.source_db, v.version, coalesce(p.current_source_version_id = v.source_version_id AND v.source_db NOT IN ('db1', 'db4'), FALSE) AS skip FROM s_registry v LEFT JOIN s_live p ON p.source_db = v.source_db")(incoming)


OWNED, CHILDREN = {f"db{i}": ["rows", "weights"] if i == 0 else ["rows"] for i in range(7)}, {"rows": "source_version_id", "weights": "source_version_id", "pointers": "current_source_version_id"}


def store_of(t) -> Store:
    """All releases that the orders make, in a store: a folder for each release of each table, the registry and the pointers."""
    made = Store(spark_of(t), f"{Scratch(spark_of(t)).root}/store")
    first = made.begin()
    rows = t("s_release_rows").select("row_id", "source_version_id", (c("is_weight") & (c("source_db") == "db0")).alias("w"))
    first.replace("rows", rows.filter("not w").drop("w"), "source_version_id")
    first.replace("weights", rows.filter("w").drop("w"), "source_version_id")
    first.replace("registry", t("s_registry").select("source_version_id", "source_db", "version", F.md5(F.concat("source_db", "version")).alias("digest")))
    first.replace("pointers", t("s_live"))
    first.commit()
    return made


def flipped(t) -> DataFrame:
    """A new release of one source loaded and flipped to, another skipped as it is the live one, in the store."""
    made, live = store_of(t), t("s_live")
    fresh = t("s_release_rows").filter("source_db = 'db3'").select("row_id")
    lifecycle.load(made, "db3", "next", "h", {"rows": fresh})
    label = t("s_registry").join(live.select(c("current_source_version_id").alias("source_version_id")), "source_version_id").filter("source_db = 'db5'").first()
    if label:
        lifecycle.load(made, "db5", label.version, hashlib.md5(f"db5{label.version}".encode()).hexdigest(), {"rows": fresh})
    rows = made.read("rows").groupBy("source_version_id").agg(F.count("*").alias("n_rows"))
    return made.read("pointers").join(rows, c("current_source_version_id") == c("source_version_id"), "left").select("source_db", "current_source_version_id", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))


_ROWS = "(SELECT count(*) FROM s_release_rows r WHERE r.source_version_id = {} AND NOT (is_weight AND source_db = 'db0'))"
plan("D03", f"SELECT source_db, current_source_version_id, {_ROWS.format('current_source_version_id')} AS n_rows FROM s_live WHERE source_db <> 'db3' UNION ALL SELECT 'db3', (SELECT max(source_version_id) + 1 FROM s_registry), (SELECT count(*) FROM s_release_rows WHERE source_db = 'db3')")(flipped)


def purged(t) -> DataFrame:
    """What a purge of all sources leaves: every release that was registered, what became of it, and its rows before and after."""
    made = store_of(t)
    found = lifecycle.purge(made, OWNED, CHILDREN, keep=1, execute=True)
    doomed = {i for p in found.plans for i in p.deletable}
    said = [(i, "deleted") for i in doomed] + [(i, "orphan") for i in found.orphans] + [(p.active, "live") for p in found.plans if p.active is not None] + [(p.prior, "prior") for p in found.plans if p.active is not None and p.prior is not None]
    roles = spark_of(t).createDataFrame(said, "source_version_id long, role string")
    count = lambda number, name: made.read("rows", number).unionByName(made.read("weights", number)).groupBy("source_version_id").agg(F.count("*").alias(name))
    both = made.read("registry", 1).join(roles, "source_version_id", "left").join(count(1, "rows_before"), "source_version_id", "left").join(count(None, "rows_after"), "source_version_id", "left")
    left = made.read("registry").select("source_version_id", F.lit(True).alias("registered"))
    return both.join(left, "source_version_id", "left").select("source_db", "source_version_id", F.coalesce("role", F.lit("kept")).alias("role"), F.coalesce("rows_before", F.lit(0).cast("long")).alias("rows_before"), F.coalesce("rows_after", F.lit(0).cast("long")).alias("rows_after"), F.coalesce("registered", F.lit(False)).alias("registered"))


plan(
    "D21",
    """WITH n AS (SELECT v.source_db, v.source_version_id, p.current_source_version_id AS live, (SELECT count(*) FROM s_release_rows r WHERE r.source_version_id = v.source_version_id) AS n FROM s_registry v LEFT JOIN s_live p ON p.source_db = v.source_db),
 k AS (SELECT *, CASE WHEN n > 0 AND source_version_id <> live THEN row_number() OVER (PARTITION BY source_db, n > 0 AND source_version_id <> live ORDER BY source_version_id DESC) END AS place FROM n),
 r AS (SELECT *, CASE WHEN live IS NULL THEN 'kept' WHEN source_version_id = live THEN 'live' WHEN n = 0 THEN 'orphan' WHEN place = 1 THEN 'prior' ELSE 'deleted' END AS role FROM k)
 SELECT source_db, source_version_id, role, n AS rows_before, CASE WHEN role = 'deleted' THEN 0 ELSE n END AS rows_after, role NOT IN ('deleted', 'orphan') AS registered FROM r""",
)(purged)
REFS = {"s_aliases": "source_version_id", "s_clinvar": "source_version_id", "s_cpic": "source_version_id", "s_dbsnp": "source_version_id", "s_gnomad": "source_version_id", "s_gwas": "source_version_id", "s_pharmgkb": "source_version_id", "s_pointers": "current_source_version_id", "s_scores": "source_version_id"}


def children_of(t) -> DataFrame:
    """Rows of every child table of the registry that refer to a version, by table and version."""
    tables = {x: t(x) for x in (*TABLES, "s_pointers", "s_aliases") if x != "s_versions"}
    every = None
    for name, column in guards.children(tables, ("source_version_id", "current_source_version_id")):
        one = tables[name].groupBy(c(column).alias("source_version_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(column).alias("column"), "source_version_id", "n")
        every = one if every is None else every.unionByName(one)
    return every


plan("D22", " UNION ALL ".join(f"SELECT '{k}' AS name, '{v}' AS \"column\", {v} AS source_version_id, count(*) AS n FROM {k} GROUP BY 3" for k, v in REFS.items()))(children_of)
plan("D24", DISC + " SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM s_calls g WHERE g.is_imputed AND g.call_id IN (d.call_a_id, d.call_b_id))")(lambda t: consensus.preclear(consensus.discrepancy_table(resolved_of(t)), t("s_calls")).drop("discrepancy_id"))


def recreated(t) -> DataFrame:
    """Two views over a table in a store, made anew after the table was replaced under them."""
    made = Store(spark_of(t), f"{Scratch(spark_of(t)).root}/views")

    def put(rows: DataFrame) -> None:
        change = made.begin()
        change.replace("frequencies", rows)
        change.commit()

    rare, every = f"rare_{uuid.uuid4().hex}", f"all_{uuid.uuid4().hex}"
    definitions = {
        rare: lambda: made.read("frequencies").filter("af_global < 0.01").groupBy("chrom").agg(F.count("*").alias("n"), F.lit("a;b").alias("tag")),
        every: lambda: made.read("frequencies").agg(F.count("*").alias("n")).select(F.lit("all").alias("chrom"), "n", F.lit("").alias("tag")),
    }
    put(t("s_gnomad").select("chrom", "af_global").limit(1))
    guards.materialise(spark_of(t), definitions)
    put(t("s_gnomad").select("freq_id", "chrom", "af_global"))
    views = guards.materialise(spark_of(t), definitions)
    return views[rare].unionByName(views[every])


plan("D28", "SELECT chrom, count(*) AS n, 'a;b' AS tag FROM s_gnomad WHERE af_global < 0.01 GROUP BY 1 UNION ALL SELECT 'all', count(*), '' FROM s_gnomad")(recreated)
plan("D33", "SELECT 's_calls' AS name, max(call_id) + 1 AS next_id FROM s_calls UNION ALL SELECT 's_clinvar', max(clinvar_id) + 1 FROM s_clinvar UNION ALL SELECT 's_variants', max(variant_id) + 1 FROM s_variants")(lambda t: guards.next_ids({"s_calls": (t("s_calls"), "call_id"), "s_clinvar": (t("s_clinvar"), "clinvar_id"), "s_variants": (t("s_variants"), "variant_id")}))
plan("D35", """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 AND c_nationkey % 2 <> 0 THEN 'already imported' WHEN c_custkey % 3 = 0 AND c_nationkey % 3 = 0 AND c_mktsegment <> 'BUILDING' THEN 'sex not determined' ELSE 'ok' END AS verdict FROM customer""")(
    lambda t: t("customer").select(
        "c_custkey",
        guards.import_verdict(
            F.when(c("c_custkey") % 4 != 0, c("c_custkey")), c("c_nationkey") % 2 == 0, c("c_custkey") % 3 == 0, F.when(c("c_nationkey") % 3 == 0, "male_nonpar_haploid").when(c("c_nationkey") % 3 == 1, "diploid"), F.when(c("c_mktsegment") == "BUILDING", "M").when(c("c_mktsegment") == "MACHINERY", "ambiguous")
        ).alias("verdict"),
    )
)
