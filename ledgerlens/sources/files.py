"""File listings and selection rules (SRC-1..4, SRC-12..16, SRC-17, DATE-6/7).

A listing is a DataFrame ``folder, file_name, modificationTime`` (plus
``path``/``length``), e.g. from ``list_files`` (Spark's ``binaryFile``
source, whose ``content`` column is never read when it is not selected).
Every selection rule is an aggregate per folder or per run (``max_by`` /
``min_by`` over a struct key); runs are joined to per-folder winners, never
to all files of a folder, so the join output stays one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import date_from_name, next_business_day, previous_quarter_end

# File-name patterns.
PERIMETER_PREFIXES = ("IR_", "XCY_IR")
PERIMETER_SUFFIX = ".xls"
PRODUCTION_PREFIX = "IFT - "
PRODUCTION_SUFFIXES = (".xlsm", ".xlsx")
SENSITIVITY_PATTERN = r"^[sS]ensis_IR_.*\.xls.*$"
COLLATERAL_SUFFIX = "Report Collatéral.xlsx"


def list_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """SRC-1: listing of a folder tree (no file content is read)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return df.select(folder.alias("folder"), name.alias("file_name"), "path", "modificationTime", "length")


def _glob_regex(pattern: str) -> str:
    out = []
    for ch in pattern:
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        else:
            out.append("\\" + ch if not ch.isalnum() else ch)
    return "^" + "".join(out) + "$"


def source_status(listing: DataFrame, sources: list[tuple[str, str]]) -> DataFrame:
    """CHK-4: for each wanted (folder, glob pattern) the files found there and
    ``missing source`` (no such folder), ``no match`` or ``found``.

    One pass and one aggregate over the listing, whatever the number of sources.
    """
    spark = listing.sparkSession
    wanted = spark.createDataFrame([(i, f, p) for i, (f, p) in enumerate(sources)], "source_no int, folder string, pattern string")
    places = [F.when(F.col("folder") == f, F.struct(F.lit(i).alias("source_no"), F.col("file_name").rlike(_glob_regex(p)).alias("hit")))
              for i, (f, p) in enumerate(sources)]
    seen = listing.select(F.inline(F.array_compact(F.array(*places)))).groupBy("source_no").agg(
        F.count_if("hit").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    status = F.when(F.col("n").isNull(), "missing source").when(n == 0, "no match").otherwise("found")
    return wanted.join(seen, "source_no", "left").select("folder", "pattern", n.alias("n_files"), status.alias("status"))


def pattern_counts(listing: DataFrame, patterns: list[str]) -> DataFrame:
    """SRC-1 + CHK-4: files matched per glob pattern, zero included (the
    reference warns on patterns that match nothing)."""
    spark = listing.sparkSession
    # one predicate per pattern (a plan-time list), no join against the listing
    hits = F.array_compact(F.array(*[F.when(F.col("file_name").rlike(_glob_regex(p)), F.lit(p)) for p in patterns]))
    counts = listing.select(F.explode(hits).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n_files"))
    pats = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    return pats.join(counts, "pattern", "left").select("pattern", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def perimeter_files(listing: DataFrame) -> DataFrame:
    """SRC-4 + STR-8: ``.xls`` files named ``IR_*`` / ``XCY_IR*`` (any case),
    in name order (``.xlsx`` members are not selected)."""
    up = F.upper("file_name")
    cond = F.lower("file_name").endswith(PERIMETER_SUFFIX)
    pref = None
    for p in PERIMETER_PREFIXES:
        t = up.startswith(p.upper())
        pref = t if pref is None else (pref | t)
    return listing.where(cond & pref)


def latest_by_name_date(listing: DataFrame, group_cols=("folder",)) -> DataFrame:
    """SRC-14 + DATE-6: per group, the production file (``IFT - *.xlsm`` /
    ``.xlsx``) with the latest ``dd-mm-yyyy`` date in its name (ties: the
    greater name); without any dated file, the greatest undated name."""
    f = listing.where(F.col("file_name").startswith(PRODUCTION_PREFIX)
                      & (F.col("file_name").endswith(PRODUCTION_SUFFIXES[0])
                         | F.col("file_name").endswith(PRODUCTION_SUFFIXES[1])))
    d = date_from_name("file_name")
    key = F.struct(d.isNotNull().alias("dated"), d.alias("d"), F.col("file_name").alias("n"))
    return f.groupBy(*group_cols).agg(F.max_by("file_name", key).alias("latest"))


def previous_production(runs: DataFrame, folder_winners: DataFrame) -> DataFrame:
    """SRC-15 + DATE-7: the production to compare a run with.

    ``runs``: ``run_date, mode``; ``folder_winners``: ``year, month, mode,
    latest`` (one row per production folder, from ``latest_by_name_date``;
    mode is null for a file that lies in the bare month folder).  The winner is
    chosen over the mode folder and the bare month folder together.  Mode ``close`` compares with the same month's ``fast``; any other mode
    with the previous quarter's ``close``.
    """
    is_close = F.lower("mode") == "close"
    pq = previous_quarter_end(F.col("run_date"))
    target = runs.select(
        "run_date", "mode",
        F.when(is_close, F.year("run_date")).otherwise(F.year(pq)).alias("t_year"),
        F.when(is_close, F.month("run_date")).otherwise(F.month(pq)).alias("t_month"),
        F.when(is_close, F.lit("fast")).otherwise(F.lit("close")).alias("t_mode"),
    )
    w = folder_winners.select(F.col("year").alias("t_year"), F.col("month").alias("t_month"),
                              F.lower("mode").alias("_mode"), F.col("latest").alias("previous"))
    here = F.col("_mode").isNull() | (F.col("_mode") == F.col("t_mode"))
    d = date_from_name("previous")
    key = F.struct(d.isNotNull().alias("dated"), d.alias("d"), F.col("previous").alias("n"))
    return (
        target.join(w, ["t_year", "t_month"], "left")
        .groupBy("t_year", "t_month", "t_mode", "run_date", "mode")
        .agg(F.max_by("previous", F.when(here & F.col("previous").isNotNull(), key)).alias("previous"))
    )


def current_production(runs: DataFrame, listing: DataFrame) -> DataFrame:
    """SRC-16 (S14): the current run's file: exact ``IFT_<tag>_<mode>.xlsm``,
    then ``.xlsx``, else the greatest ``IFT*.xls*`` name of its folder.

    ``runs``: ``folder, run_date, mode``; the tag is the next business day
    (one tag function for both the name and the lookup).
    """
    tag = F.date_format(next_business_day(F.col("run_date")), "MMddyyyy")
    base = F.concat(F.lit("IFT_"), tag, F.lit("_"), F.lower("mode"))
    r = runs.withColumn("_xlsm", F.concat(base, F.lit(".xlsm"))).withColumn("_xlsx", F.concat(base, F.lit(".xlsx")))
    names = listing.select("folder", "file_name")
    exact_m = names.select("folder", F.col("file_name").alias("_xlsm"), F.col("file_name").alias("_hit_m"))
    exact_x = names.select("folder", F.col("file_name").alias("_xlsx"), F.col("file_name").alias("_hit_x"))
    fallback = (
        names.where(F.col("file_name").startswith("IFT") & F.col("file_name").contains(".xls"))
        .where(F.col("file_name").rlike(r"^IFT.*\.xls.*$"))
        .groupBy("folder").agg(F.max("file_name").alias("_last"))
    )
    j = (r.join(exact_m.distinct(), ["folder", "_xlsm"], "left")
         .join(exact_x.distinct(), ["folder", "_xlsx"], "left")
         .join(fallback, "folder", "left"))
    return j.select("folder", "run_date", "mode", F.coalesce("_hit_m", "_hit_x", "_last").alias("current"))


def first_by_prefix(listing: DataFrame, org: str) -> DataFrame:
    """SRC-13: per folder and date, the first feed file (by name) whose name
    starts with ``search_<org>_<yyyy-MM-dd>``, exact case preferred over a
    case-insensitive match."""
    pat = rf"(?i)^search_{org}_([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})"
    d = F.regexp_extract("file_name", pat, 1)
    f = listing.where(F.lower("file_name").endswith(".csv")).withColumn("feed_date", d).where(F.col("feed_date") != "")
    exact = F.col("file_name").startswith(F.concat(F.lit(f"search_{org}_"), F.col("feed_date")))
    return f.groupBy("folder", "feed_date").agg(
        F.min(F.struct((~exact).alias("inexact"), F.col("file_name").alias("n"))).alias("_b")
    ).select("folder", "feed_date", F.col("_b.n").alias("feed_file"), (~F.col("_b.inexact")).alias("exact_case"))


def first_sensitivity_file(listing: DataFrame) -> DataFrame:
    """SRC-13: first ``[sS]ensis_IR_*.xls*`` name per folder."""
    return listing.where(F.col("file_name").rlike(SENSITIVITY_PATTERN)).groupBy("folder").agg(
        F.min("file_name").alias("sensis_file")
    )


def latest_by_mtime(listing: DataFrame, suffix: str = COLLATERAL_SUFFIX) -> DataFrame:
    """SRC-12: per folder, the ``*<suffix>`` file modified last."""
    return listing.where(F.col("file_name").endswith(suffix)).groupBy("folder").agg(
        F.max_by("file_name", F.struct("modificationTime", "file_name")).alias("latest")
    )


def collision_names(members: DataFrame, existing: DataFrame) -> DataFrame:
    """SRC-3: flattened member names made unique in their destination.

    ``members``: ``dest, basename, ord`` (extraction order); ``existing``:
    ``dest, file_name``.  In extraction order each member takes its basename
    or the first of ``<stem>_1<ext>``, ``<stem>_2<ext>`` ... that neither an
    existing file nor an earlier member has.  ``collides`` flags the members
    that needed a suffix.

    The k-th member (0-based) of a basename cannot do better than suffix k (one
    more where the plain name exists), so all start there at once.  Then every
    name goes to its earliest claimant, and who loses it, or claims an existing
    name, tries the next suffix, until nobody loses.  Further rounds only
    happen where a suffixed name is also somebody's own name.
    """
    from ..operators.placement import sequential_index
    from ..session import materialize

    stem = F.regexp_extract("basename", r"^(.*?)(\.[^.]*)?$", 1)
    ext = F.regexp_extract("basename", r"^(.*?)(\.[^.]*)?$", 2)
    have = existing.select("dest", F.col("file_name").alias("target_name"), F.lit(True).alias("_have")).distinct()
    # occurrence number per (dest, basename) in extraction order: range-partitioned
    # numbering, so one very common name is not numbered inside a single task
    state = sequential_index(members, ["ord"], group_cols=["dest", "basename"], name="_j", start=0)
    plain = have.select("dest", F.col("target_name").alias("basename"), F.lit(1).alias("_pre"))
    state = state.join(plain, ["dest", "basename"], "left").withColumn("_j", F.col("_j") + F.coalesce("_pre", F.lit(0)))
    name = F.when(F.col("_j") == 0, F.col("basename")).otherwise(F.concat(stem, F.lit("_"), F.col("_j").cast("string"), ext))
    claim = F.struct("ord", "basename", "_j")
    while True:
        claims = state.withColumn("target_name", name)
        winners = claims.groupBy("dest", "target_name").agg(F.min(claim).alias("_first"))
        judged = claims.join(winners, ["dest", "target_name"]).join(have, ["dest", "target_name"], "left")
        lost = F.coalesce("_have", F.lit(False)) | (claim != F.col("_first"))
        judged = materialize(judged.withColumn("_lost", lost), "claims")
        if judged.where("_lost").isEmpty():
            break
        state = judged.withColumn("_j", F.col("_j") + F.col("_lost").cast("int")).select(*members.columns, "_j")
    return judged.select(*members.columns, "target_name", (F.col("target_name") != F.col("basename")).alias("collides"))
