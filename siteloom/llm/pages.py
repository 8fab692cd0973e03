"""Page text for training data: residue, repeated lines of a site, text quality, main content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.blocks import BAD, GOOD, brand_of, content_lines, form_key
from siteloom.llm.quality import KINDS, LEAST_SPREAD, NOISE, STATS, STEPS, page_stats
from siteloom.llm.residue import COVERAGE, body_kind, short_field
from siteloom.session import staged

# ---------------------------------------------------------------- lines a site repeats, as link density of its pages

#: A line is frequent on a site from this many rows, and from this share (1 in N) of its rows with text.
LEAST_ROWS, LEAST_SHARE_OF = 5, 5
#: Rows from which a form of at most so many characters counts as repeated all the same; a fetch repeated twice makes two rows.
FEW_ROWS, SHORT_FORM = 3, 80
#: Forms that a task counts before it hands them on, and sites whose forms a task keeps.
COUNTED_FORMS, KEPT_SITES = 500_000, 2_000


def site_of(url: Column) -> Column:
    """Host of a URL in lower case, without port and user; null if it has none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(host != "", host)


def _counted(counts: dict[tuple[int, int], int]) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.array([k[1] == 0 for k in keys], pa.bool_())], names=["site", "form", "n", "is_total"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], int] = {}
    for batch in batches:
        for site, host, body in zip(*(batch.column(c).to_pylist() for c in ("site", "host", "body_text"))):
            brand = brand_of(host)
            for form in {form_key(x, brand) for x in map(str.strip, body.split("\n")) if x} | {0}:
                counts[site, form] = counts.get((site, form), 0) + 1
        if len(counts) > COUNTED_FORMS:
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def site_lines(pages: DataFrame, least_rows: int = LEAST_ROWS, share_of: int = LEAST_SHARE_OF) -> DataFrame:
    """``site, repeated``: per site (hash of the host) the keys of the line forms that it repeats on many of its pages:
    in a fifth of its rows with text, and in five of them, or three where the form is short.

    Counts are added up inside tasks before they are shuffled by (site, form), so a hot site spreads over its
    forms. A site's array is bounded: with a form in at least 1 of N rows, it holds at most N times
    the mean number of lines of the site's pages.
    """
    host = site_of(F.col("final_url"))
    texts = pages.where(F.col("body_text").isNotNull() & host.isNotNull()).select(F.xxhash64(host).alias("site"), host.alias("host"), "body_text")
    once = texts.mapInArrow(_forms, "site bigint, form bigint, n bigint, is_total boolean")
    # the flag is aggregated, so that its filter stays above the shuffle, which both sides then share
    counts = once.groupBy("site", "form").agg(F.sum("n").alias("n"), F.max("is_total").alias("is_total"))
    totals = counts.where("is_total").select("site", F.col("n").alias("rows"))
    short = (F.shiftright("form", 32) <= SHORT_FORM) & (F.col("n") >= min(FEW_ROWS, least_rows))
    frequent = counts.where(~F.col("is_total") & (short | (F.col("n") >= least_rows))).join(totals, "site").where(F.col("n") * share_of >= F.col("rows"))
    return frequent.groupBy("site").agg(F.collect_list("form").alias("repeated"))


def with_site_lines(pages: DataFrame, *columns: str) -> DataFrame:
    """The named columns, the host, a hash of it, and the keys of the lines its site repeats (null if none).

    The table of sites grows with their number, so it is never broadcast; the pages are shuffled by site, where adaptive
    execution splits a hot one. Pages
    without a site get a hash of their own, so that they don't meet in one task.
    """
    host = site_of(F.col("final_url"))
    each = pages.select(*columns, host.alias("host"), F.coalesce(F.when(host.isNotNull(), F.xxhash64(host)), F.xxhash64("page_id", "final_url")).alias("site"))
    # the lists of a partition's sites are few, so they are hashed and the texts aren't sorted
    return each.join(site_lines(pages).hint("shuffle_hash"), "site", "left")


def _judged(batch: pa.RecordBatch, sets: dict[int, frozenset[int]]) -> Iterator[tuple[str | None, str | None, list[str], list[int]]]:
    """Title, body, lines and labels of each row of a batch of ``with_site_lines``."""
    repeated = batch.column("repeated")
    for i, (site, host, title, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("site", "host", "title", "body_text")))):
        if body is None:
            yield title, body, [], []
            continue
        known = sets.get(site)
        if known is None:
            if len(sets) >= KEPT_SITES:
                sets.clear()
            known = sets[site] = frozenset(repeated[i].as_py() or ())
        yield title, body, *content_lines(body, title, known, brand_of(host))


# ---------------------------------------------------------------- 1: template residue and error text


def _residue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, frozenset[int]] = {}
    for batch in batches:
        rows: list[tuple[int, str, str]] = []
        for page, meta, (title, body, lines, labels) in zip(batch.column("page_id").to_pylist(), batch.column("meta_description").to_pylist(), _judged(batch, sets)):
            found = [("title", short_field(title, True)), ("meta_description", short_field(meta, False))]
            if body and not body.isspace():
                found.append(("body_text", body_kind(lines, labels, title)))
            rows += [(page, name, kind) for name, kind in found if kind]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["page_id", "field_name", "kind"]
        )


def template_residue(pages: DataFrame) -> DataFrame:
    """``page_id, field_name, kind`` for each title, description and body that is residue.

    ``kind`` is variable, filler, error or scripts. A body is judged by its main part, for which the lines that
    its site repeats are counted first. Null and blank fields are none; repeated rows repeat their
    result; further columns are ignored.
    """
    return with_site_lines(pages, "page_id", "title", "meta_description", "body_text").mapInArrow(_residue, "page_id bigint, field_name string, kind string")


def without_residue(pages: DataFrame) -> DataFrame:
    """The pages of which no field is residue."""
    return pages.join(template_residue(pages).select("page_id").distinct(), "page_id", "left_anti")


# ---------------------------------------------------------------- 2: lines a site repeats

def line_form(line: Column) -> Column:
    """Trimmed, white space runs as one space, lower case, digit runs as one sign."""
    spaced = F.regexp_replace(line, r"(?U)\s+", " ")
    return F.regexp_replace(F.lower(F.regexp_replace(spaced, "^ | $", "")), "[0-9]+", "#")


def _site_texts(pages: DataFrame) -> DataFrame:
    """(page_id, site, forms): per page with text and site, the hashes of its lines' forms; null for blank lines."""
    site = site_of(F.col("final_url"))
    base = pages.where(F.col("body_text").isNotNull() & site.isNotNull()).select("page_id", F.xxhash64(site).alias("site"), F.transform(F.split("body_text", "\n"), line_form).alias("forms"))
    hashed = F.transform("forms", lambda f: F.when(f != "", F.struct(F.xxhash64(F.col("site"), f).alias("h1"), F.hash(f).alias("h2"))))
    return base.select("page_id", "site", hashed.alias("forms"))


def _frequent(texts: DataFrame, least_rows: int, share_of: int) -> DataFrame:
    once = texts.select("site", F.explode(F.array_distinct(F.filter("forms", lambda f: f.isNotNull()))).alias("f"))
    counts = once.groupBy("site", "f.h1", "f.h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_rows)
    rows = texts.groupBy("site").agg(F.count(F.lit(1)).alias("rows"))
    return counts.join(rows, "site").where(F.col("n") * share_of >= F.col("rows")).select("h1", "h2", "n")


def frequent_lines(pages: DataFrame, least_rows: int = LEAST_ROWS, share_of: int = LEAST_SHARE_OF) -> DataFrame:
    """``h1, h2, n`` of the line forms that a site repeats on many of its pages.

    A form counts once per row: its hashes are made distinct inside the row, so counting needs
    one shuffle, after map-side pre-aggregation that shrinks a hot site's lines to their forms.
    """
    return _frequent(staged(_site_texts(pages), "line-forms"), least_rows, share_of)


def repeated_site_lines(pages: DataFrame, least_rows: int = LEAST_ROWS, share_of: int = LEAST_SHARE_OF) -> DataFrame:
    """``page_id, line_no`` of every line whose form its site repeats.

    Sites and forms travel as 96-bit hashes. Rows without a host in ``final_url`` belong to no
    site; null and empty bodies have no lines; further columns are ignored. Forms are computed and written
    once, for the count and for the join, which is by equality, so a hot site's lines spread over their forms' hashes.
    """
    texts = staged(_site_texts(pages), "line-forms")
    lines = texts.select("page_id", F.posexplode("forms").alias("line_no", "f")).where("f is not null").select("page_id", "line_no", "f.h1", "f.h2")
    found = lines.join(_frequent(texts, least_rows, share_of).select("h1", "h2"), ["h1", "h2"], "left_semi")
    return found.select("page_id", F.col("line_no").cast("int").alias("line_no"))


def without_lines(pages: DataFrame, drop: DataFrame, text: str = "clean_text") -> DataFrame:
    """``page_id`` and the body rebuilt without the lines named by ``drop(page_id, line_no)``.

    ``page_id`` must be unique. A null body stays null; a body all of whose lines go is ''.
    """
    gone = drop.groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("body_text", "\n"), lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i.cast("int")))
    return pages.select("page_id", "body_text").join(gone, "page_id", "left").select("page_id", F.array_join(kept, "\n").alias(text))


# ---------------------------------------------------------------- 3: text quality

#: A page is an outlier beyond this squared distance: the 99 % point of chi-square with eight degrees.
FAR = 20.09
#: Languages with fewer pages than this use the mean and covariance of all languages together.
FEWEST_PAGES = 50
#: Rounds in which mean and covariance are fitted again to the pages that are no outliers of the last fit.
ROUNDS = 3

#: Language ('' for all together), mean, covariance with its ridge.
Model = tuple[str, np.ndarray, np.ndarray]


def _quality(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, frozenset[int]] = {}
    for batch in batches:
        out: list[tuple] = []
        for page, count, (title, body, lines, labels) in zip(batch.column("page_id").to_pylist(), batch.column("word_count").to_pylist(), _judged(batch, sets)):
            lang, stats, n, m, foreign = page_stats(lines, labels)
            main = [len(x) for x, label in zip(lines, labels) if label == GOOD]
            has_text = bool(main)
            pieces = len(body.split()) if body else 0
            # most pages hold too much that no message has, and needn't be read for one
            residue = has_text and foreign <= (1 - COVERAGE) * sum(main) and body_kind(lines, labels, title) not in ("", "variable")
            out.append((page, lang, *stats, n, m, residue, pieces, count is not None and count != pieces, has_text))
        types = [pa.int64(), pa.string(), *[pa.float64()] * len(STATS), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_()]
        names = ["page_id", "lang", *STATS, "n_words", "n_lines", "residue", "words", "wrong_count", "has_text"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def page_statistics(pages: DataFrame) -> DataFrame:
    """Per page: language, the statistics of its main part, the words and lines they rest on, whether it is
    residue, and the word count of the whole body."""
    schema = "page_id bigint, lang string, " + ", ".join(f"{s} double" for s in STATS) + ", n_words int, n_lines int, residue boolean, words int, wrong_count boolean, has_text boolean"
    return with_site_lines(pages, "page_id", "title", "body_text", "word_count").mapInArrow(_quality, schema)


def _start(known: DataFrame) -> dict[str, tuple[int, list[float], list[float]]]:
    """Per language ('' for all) pages, medians and median deviations, from one histogram: at most a thousand
    rows per language and statistic reach the driver."""
    buckets = F.array(*[F.least(F.lit(1001), F.round(F.col(s) / step).cast("int")) for s, step in zip(STATS, STEPS)])
    rows = known.select("lang", F.posexplode(buckets).alias("stat", "bucket")).groupBy("lang", "stat", "bucket").count().collect()
    counts: dict[str, list[dict[int, int]]] = {}
    for r in rows:
        for key in (r["lang"], ""):
            per = counts.setdefault(key, [{} for _ in STATS])[r["stat"]]
            per[r["bucket"]] = per.get(r["bucket"], 0) + r["count"]

    def median(values: dict[float, int]) -> float:
        half, seen = sum(values.values()) / 2, 0
        for v in sorted(values):
            seen += values[v]
            if seen >= half:
                return v
        return 0.0

    out = {}
    for key, per in counts.items():
        mid = [median(h) for h in per]
        dev: list[dict[float, int]] = [{} for _ in per]
        for d, h, c in zip(dev, per, mid):
            for v, n in h.items():
                d[abs(v - c)] = d.get(abs(v - c), 0) + n
        out[key] = sum(per[0].values()), [c * step for c, step in zip(mid, STEPS)], [median(d) * step for d, step in zip(dev, STEPS)]
    return out


def _fit(rows: DataFrame) -> list[Model]:
    """Mean and covariance per language and of all; the driver receives one row of sums per language."""
    n = len(STATS)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.rollup("use").agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(STATS)], *[F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p{i}_{j}") for i, j in pairs])
    models = []
    for r in sums.collect():
        if r["n"] > n and r["use"] != "":
            mean = np.array([r[f"s{i}"] / r["n"] for i in range(n)])
            cov = np.zeros((n, n))
            for i, j in pairs:
                cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
            models.append((r["use"] or "", mean, cov + np.diag(np.square(LEAST_SPREAD))))
    return models


def _measured(rows: DataFrame, models: list[Model], noise: bool) -> DataFrame:
    """``rows`` with ``distance`` and its parts ``from_<statistic>``, null without a model."""
    n = len(STATS)
    schema = "use string, " + ", ".join(f"{c}{i} double" for c in "mv" for i in range(n)) + ", " + ", ".join(f"i{i}_{j} double" for i in range(n) for j in range(n))
    table = F.broadcast(rows.sparkSession.createDataFrame([(k, *map(float, mean), *map(float, np.diag(cov)), *map(float, np.linalg.inv(cov).ravel())) for k, mean, cov in models], schema))
    delta = []
    for i, (fixed, word, line) in enumerate(NOISE):
        d = F.col(STATS[i]) - F.col(f"m{i}")
        own = F.lit(float(fixed)) + F.lit(float(word)) / F.col("n_words") + F.lit(float(line)) / F.col("n_lines")
        delta.append(d * F.sqrt(F.col(f"v{i}") / (F.col(f"v{i}") + own)) if noise else d)
    with_delta = rows.join(table, "use", "left").withColumns({f"d{i}": d for i, d in enumerate(delta)})
    parts = {f"from_{s}": F.col(f"d{i}") * sum((F.col(f"i{i}_{j}") * F.col(f"d{j}") for j in range(1, n)), F.col(f"i{i}_0") * F.col("d0")) for i, s in enumerate(STATS)}
    measured = with_delta.withColumns(parts)
    return measured.withColumn("distance", sum((F.col(f"from_{s}") for s in STATS[1:]), F.col(f"from_{STATS[0]}")))


def prose_models(stats: DataFrame, far: float = FAR) -> tuple[list[Model], Column]:
    """The models of prose, and the column that tells which of them a page uses.

    Robust: the first fit takes the pages within three scaled median deviations in every statistic, each
    further one the pages within ``far`` of the last fit, so lists, tables and junk don't shape what prose is.
    """
    known = stats.where("lang != '' and has_text and not residue")
    start = _start(known)
    langs = [k for k, (n, _, _) in sorted(start.items()) if k and n >= FEWEST_PAGES]
    use = F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(F.lit("*")) if langs else F.lit("*")
    if not start:
        return [], use
    pick = lambda i, at: F.coalesce(*[F.when(F.col("lang") == k, F.lit(float(start[k][at][i]))) for k in langs], F.lit(float(start[""][at][i])))
    near = F.lit(True)
    for i, s in enumerate(STATS):
        near = near & (F.abs(F.col(s) - pick(i, 1)) <= 3 * F.greatest(F.lit(LEAST_SPREAD[i]), 1.4826 * pick(i, 2)))
    named = known.withColumn("use", use)
    every = lambda models: [("*" if k == "" else k, m, c) for k, m, c in models if k != "*"]
    models = every(_fit(named.where(near)))
    for _ in range(ROUNDS - 1):
        if models:
            models = every(_fit(_measured(named, models, False).where(F.col("distance") <= far).select("use", *STATS)))
    return models, use


def verdict_of(far: float) -> Column:
    """What an outlier is: the kind whose statistics contribute most to its distance."""
    votes = {}
    for kind, members in KINDS.items():
        parts = [F.when(F.lit(side) * F.col(f"d{STATS.index(s)}") >= 0, F.greatest(F.lit(0.0), F.col(f"from_{s}"))).otherwise(F.lit(0.0)) for s, side in members]
        votes[kind] = sum(parts[1:], parts[0])
    most = F.greatest(*votes.values())
    kind = F.lit("prose")
    for name, vote in votes.items():
        kind = F.when((vote == most) & (vote > 0), name).otherwise(kind)
    return F.when(~F.col("has_text"), "empty").when(~F.col("residue") & (F.col("distance") > far), kind).otherwise("prose")


def text_quality(pages: DataFrame, far: float = FAR) -> DataFrame:
    """Distance of each page's main part from prose of its language, and the verdict.

    Output: ``page_id, lang``, the statistics, ``distance`` (squared Mahalanobis), one ``from_<statistic>`` per
    statistic (its contribution; they sum to the distance), ``words``, ``wrong_count``, and ``verdict``: for a
    page farther than ``far`` list, table or junk, whichever its contributions make it; prose otherwise, and for
    filler, messages and notices; empty without text. A short page's deviations are scaled down by their
    sampling error. Null and blank bodies have no words; pages without a known language are measured against all
    languages together; where there is no prose to fit, everything is prose; an empty table gives an empty
    result. Statistics are written once and read by the small aggregations of the fit and by the scoring.
    """
    stats = staged(page_statistics(pages), "page-statistics")
    models, use = prose_models(stats, far)
    scored = _measured(stats.withColumn("use", use), models, True)
    return scored.select("page_id", "lang", *STATS, "distance", *[f"from_{s}" for s in STATS], "words", "wrong_count", verdict_of(far).alias("verdict"))


# ---------------------------------------------------------------- 4: main content


def _boilerplate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, frozenset[int]] = {}
    for batch in batches:
        ids: list[int] = []
        numbers: list[int] = []
        for page, (_, _, _, labels) in zip(batch.column("page_id").to_pylist(), _judged(batch, sets)):
            bad = [i for i, label in enumerate(labels) if label == BAD]
            ids += [page] * len(bad)
            numbers += bad
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["page_id", "line_no"])


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """``page_id, line_no`` of the non-blank lines that aren't main content, by the rules of ``llm.blocks`` with
    the site's repeated lines as link density. Null, empty and blank bodies give nothing; pages without a
    host are judged without a site."""
    return with_site_lines(pages, "page_id", "title", "body_text").mapInArrow(_boilerplate, "page_id bigint, line_no int")


def _main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, frozenset[int]] = {}
    for batch in batches:
        texts = [None if body is None else "\n".join(x for x, label in zip(lines, labels) if label == GOOD) for _, body, lines, labels in _judged(batch, sets)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "main_text"])


def main_content(pages: DataFrame) -> DataFrame:
    """``page_id, main_text``: the lines of main content; null for a null body."""
    return with_site_lines(pages, "page_id", "title", "body_text").mapInArrow(_main, "page_id bigint, main_text string")
