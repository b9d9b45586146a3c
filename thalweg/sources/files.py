"""Files: free-format tables, package files, lines in text, saved networks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.functions import geometry as G
from thalweg.operators.network import Network

#: A quoted string, or anything up to the next blank.
FIELD = r"'[^']*'|[^\s']\S*"
# Column names of ten letters or fewer for files that allow no more.
SHORT_NAMES = {
    "to_segnum": "to_seg", "from_segnums": "from_seg", "num_to_outlet": "num_to_out", "dist_to_outlet": "dst_to_out", "stream_order": "strm_order",
    "upstream_length": "upstr_len", "upstream_area": "upstr_area", "inflow_segnums": "inflow_seg", "zcoord_count": "zcoord_num", "zcoord_first": "zcoordfrst",
    "zcoord_last": "zcoordlast", "strtop_incopt": "stpincopt", "prev_ibound": "previbound", "prev_idomain": "prevdomain", "dist_to_reach": "dst_to_rch",
    "dist_to_segnum": "dst_to_seg", "dist_to_seg": "dst_to_seg", "is_within_catchment": "within_cat", "div_from_rno": "divfromrno", "div_to_rnos": "divtornos",
    "div_from_ifno": "divfromfno", "div_to_ifnos": "divtofnos",
}


def read_lines(spark: SparkSession, path: str, *, key: str = "segnum", wkt: str = "wkt", format: str = "parquet", **options) -> DataFrame:
    """``segnum, pos, geometry`` and other columns of a table with lines in well-known text; ``pos`` follows the key."""
    rows = spark.read.format(format).options(**options).load(path)
    return rows.select(F.col(key).cast("long").alias("segnum"), F.col(key).cast("long").alias("pos"), G.from_wkt(F.col(wkt)).alias("geometry"), *[c for c in rows.columns if c not in (key, wkt)])


def write_text(rows: DataFrame, head: str | None, path: str) -> None:
    """``rows(order, value)`` in their order as one text file ``path``, with ``head`` as its first line.

    Sorted by all executors into a folder of parts, which are then joined on
    the file system, so no task or driver holds the whole text.
    """
    spark = rows.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    rows.orderBy("order").select("value").write.option("lineSep", "\n").text(parts)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    fs = target.getFileSystem(conf)
    out = fs.create(target, True)
    try:
        if head is not None:
            out.write(bytearray((head + "\n").encode()))
        names = sorted(str(f.getPath().getName()) for f in fs.listStatus(folder))
        for name in names:
            if name.startswith("part-"):
                part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                part.close()
    finally:
        out.close()
        fs.delete(folder, True)


def write_table(df: DataFrame, path: str, *, comment_header: bool = True, index: bool = True, null_number: str = "NaN", quote: bool = True) -> None:
    """A free-format text table in one file, its header first, with columns lined up: numbers to the right, words to the left, quoted where they hold a blank, null words left out at the end.

    The first column is the row's number, lined up to the left; rows are
    written in its order. Without ``index`` it only gives the order and isn't
    written. Widths come from one aggregation of longest values.
    """
    first, others = df.columns[0], df.columns[1:]
    is_text = {f.name: f.dataType.simpleString() == "string" for f in df.schema}

    def shown(c: str) -> Column:
        text = F.col(c).cast("string")
        if is_text[c]:
            return F.coalesce(F.when(text.contains(" ") & F.lit(quote), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text), F.lit(""))
        return F.coalesce(text, F.lit(null_number))

    rows = df.select(F.col(first).alias("_order"), *[shown(c).alias(c) for c in df.columns])
    widths = rows.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)).alias(c) for c in df.columns]).first()
    mark = "# " if comment_header else ""
    width = {c: max(widths[c], len(c)) for c in others}
    lead = max(widths[first], len(mark + first))
    pad = lambda c: F.rpad(c, width[c], " ") if is_text[c] else F.lpad(c, width[c], " ")
    named = [c.ljust(width[c]) if is_text[c] else c.rjust(width[c]) for c in others]
    if index:
        line, head = F.concat_ws("  ", F.rpad(first, lead, " "), *[pad(c) for c in others]), "  ".join([(mark + first).ljust(lead), *named])
    else:
        line, head = F.concat_ws("  ", *[pad(c) for c in others]), mark + "  ".join(named)
    write_text(rows.select(F.col("_order").alias("order"), F.rtrim(line).alias("value")), head.rstrip(), path)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A free-format table as ``write_table`` has it: a text file whose first line is the header.

    Fields are split at blanks outside single quotes; those missing at the end
    of a line are null; columns become numbers if all their values are.
    """
    lines = spark.read.text(path)
    names = (lines.first() or [""])[0]
    lines = lines.where(F.col("value") != names)
    names = names.lstrip("#").split()
    fields = lines.select(F.regexp_extract_all("value", F.lit(FIELD), F.lit(0)).alias("f")).where(F.size("f") > 0)
    cols = [F.regexp_replace(F.get("f", F.lit(k)), "^'|'$", "").alias(n) for k, n in enumerate(names)]
    rows = fields.select(*cols)
    if not names:
        return rows
    bad = rows.agg(*[F.count_if(F.col(n).isNotNull() & F.col(n).try_cast("bigint").isNull()).alias(f"i{k}") for k, n in enumerate(names)], *[F.count_if(F.col(n).isNotNull() & F.col(n).try_cast("double").isNull()).alias(f"d{k}") for k, n in enumerate(names)]).first()
    return rows.select(*[F.col(n).cast("bigint" if not bad[f"i{k}"] else "double" if not bad[f"d{k}"] else "string").alias(n) for k, n in enumerate(names)])


def write_connection_data(connections: DataFrame, path: str) -> None:
    """``ridx`` and its connections, numbers lined up to the right, as many columns as the longest row needs."""
    rows = connections.select(F.col("ridx").alias("order"), F.col("ridx").cast("string").alias("r"), F.transform("connections", lambda x: x.cast("string")).alias("c"))
    state = rows.agg(F.max(F.length("r")).alias("r"), F.max(F.array_max(F.transform("c", lambda x: F.length(x)))).alias("c"), F.max(F.size("c")).alias("n")).first()
    columns = state["n"] or 0
    width, lead = max(state["c"] or 1, len(f"ic{columns}")), max(state["r"] or 1, len("# ridx"))
    line = F.concat_ws(" ", F.rpad("r", lead, " "), F.array_join(F.transform("c", lambda x: F.lpad(x, width, " ")), " "))
    head = " ".join(["# ridx".ljust(lead), *[f"ic{k + 1}".rjust(width) for k in range(columns)]])
    write_text(rows.select("order", F.rtrim(line).alias("value")), head, path)


def write_package_data(package: DataFrame, path: str) -> None:
    """PACKAGEDATA in one file: cells of inactive reaches are NONE, names that hold a blank are quoted."""
    none = lambda c: F.when(F.col(c).isNull(), F.lit("NONE") if c == "k" else F.lit("")).otherwise(F.col(c).cast("string"))
    rows = package.select("ridx", F.trim(F.concat_ws(" ", *[none(c) for c in "kij"])).alias("cell"), *[c for c in package.columns if c not in ("ridx", "k", "i", "j")])
    names = {f.name: f.dataType.simpleString() for f in rows.schema}
    widths = rows.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in rows.columns]).first()
    named = {"ridx": "# ridx", "cell": "k i j"} | {c: c for c in rows.columns if c not in ("ridx", "cell")}
    width = {c: max(widths[c] + 2 * (names[c] == "string" and c != "cell"), len(named[c])) for c in rows.columns}

    def shown(c: str) -> Column:
        text = F.col(c).cast("string")
        if names[c] == "string" and c != "cell":
            return F.rpad(F.coalesce(F.when(text.contains(" "), F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text), F.lit("")), width[c], " ")
        return F.rpad(text, width[c], " ") if c in ("ridx", "cell") else F.lpad(F.coalesce(text, F.lit("NONE")), width[c], " ")

    head = "  ".join(named[c].ljust(width[c]) if c in ("ridx", "cell") or names[c] == "string" else named[c].rjust(width[c]) for c in rows.columns)
    write_text(rows.select(F.col("ridx").alias("order"), F.rtrim(F.concat_ws("  ", *[shown(c) for c in rows.columns])).alias("value")), head.rstrip(), path)


def write_diversions(diversions: DataFrame, path: str) -> None:
    """DIVERSIONS in one file: ``ridx, idv, iconr, cprior``, by reach and number."""
    rows = diversions.select(F.struct("ridx", "idv").alias("order"), "ridx", "idv", "iconr", "cprior")
    cols = ("ridx", "idv", "iconr", "cprior")
    widths = rows.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in cols]).first()
    named = {c: ("# " if c == "ridx" else "") + c for c in cols}
    width = {c: max(widths[c], len(named[c])) for c in cols}
    line = F.concat_ws(" ", *[(F.rpad if c in ("ridx", "cprior") else F.lpad)(F.col(c).cast("string"), width[c], " ") for c in cols])
    write_text(rows.select("order", F.rtrim(line).alias("value")), " ".join(named[c].ljust(width[c]) if c in ("ridx", "cprior") else named[c].rjust(width[c]) for c in cols).rstrip(), path)


def write_periods(frame: DataFrame, path: str, *, header: bool = True) -> None:
    """One text file a stress period with its rows of ``frame(per, k, i, j, ...)``, numbers lined up to the right; ``{}`` in ``path`` takes the period's number, with a format as in ``{:02d}``.

    With ``header`` (as the newer packages read it) the first line names the
    columns after ``#``, without it there are rows only. Periods are few and
    known to the driver, each is written as a table of its own.
    """
    if "{" not in path:
        raise ValueError("path must have a place for the period")
    cols = [c for c in frame.columns if c != "per"]
    texts = frame.select("per", *[F.coalesce(F.col(c).cast("string"), F.lit("NONE")).alias(c) for c in cols], F.struct(*[F.col(c) for c in cols]).alias("order"))
    for (per,) in texts.select("per").distinct().orderBy("per").collect():
        mine = texts.where(F.col("per") == per)
        widths = mine.agg(*[F.max(F.length(c)).alias(c) for c in cols]).first()
        width = {c: max(widths[c], len(c)) if header else widths[c] for c in cols}
        head = "# " + " ".join(c.rjust(width[c]) for c in cols) if header else None
        line = F.concat_ws(" ", *[F.lpad(c, width[c], " ") for c in cols])
        write_text(mine.select("order", (F.concat(F.lit("  "), line) if header else line).alias("value")), head, path.format(per))


def read_long_series(spark: SparkSession, path: str, *, time: str = "ts", key: str = "rchid", value: str = "q", mult: float = 1.0, run: int | None = None, format: str = "parquet", **options) -> DataFrame:
    """``(<time>, <key>, <value>)`` of a long table of a time series, values times ``mult``. Where it holds several runs (``nrun`` or ``nens``), that numbered ``run``, the first unless given."""
    rows = spark.read.format(format).options(**options).load(path)
    lost = [c for c in (time, key, value) if c not in rows.columns]
    if lost:
        raise KeyError(f"{lost[0]!r} not found in dataset; use one of {rows.columns}")
    for name in ("nrun", "nens"):
        if name in rows.columns:
            rows = rows.where(F.col(name) == (0 if run is None else run))
    return rows.select(time, key, (F.col(value) * F.lit(float(mult))).alias(value))


def flat_columns(df: DataFrame) -> DataFrame:
    """Columns as simple files take them: truth values as numbers, arrays and other kinds as text, null words empty, names of ten letters at most."""
    out = []
    for f in df.schema:
        kind, name = f.dataType.simpleString(), SHORT_NAMES.get(f.name, f.name)[:10]
        if kind == "boolean":
            out.append(F.col(f.name).cast("int").alias(name))
        elif kind == G.LINE:
            out.append(G.to_wkt(F.col(f.name)).alias(name))
        elif kind.startswith("array"):
            out.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), ",").alias(name))
        elif kind == "string":
            out.append(F.coalesce(f.name, F.lit("")).alias(name))
        else:
            out.append(F.col(f.name).alias(name))
    return df.select(*out)


def save(network: Network, path: str) -> None:
    """A network as Parquet tables and a small JSON file."""
    network.segments.write.mode("overwrite").parquet(f"{path}/segments")
    parts = [n for n in ("catchments", "diversions", "problems") if getattr(network, n) is not None]
    for name in parts:
        getattr(network, name).write.mode("overwrite").parquet(f"{path}/{name}")
    _write_text(network.segments.sparkSession, f"{path}/network.json", json.dumps({"end": network.end, "parts": parts}))


def load(spark: SparkSession, path: str) -> Network:
    """A network that ``save`` wrote."""
    state = json.loads("".join(r[0] for r in spark.read.text(f"{path}/network.json").collect()))
    parts = {n: spark.read.parquet(f"{path}/{n}") for n in state["parts"]}
    return Network(spark.read.parquet(f"{path}/segments"), state["end"], parts.get("catchments"), parts.get("diversions"), parts.get("problems"))


def save_model(model, path: str) -> None:
    """A reach network (see ``sfr``) as Parquet tables and a small JSON file, its stream network beside it."""
    save(model.network, f"{path}/network")
    for name in ("reaches", "segments", "links", "diversions"):
        frame = getattr(model, name)
        if frame is not None:
            frame.write.mode("overwrite").parquet(f"{path}/{name}")
    parts = [n for n in ("reaches", "segments", "links", "diversions") if getattr(model, n) is not None]
    grid = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(model.grid).items()}
    _write_text(model.reaches.sparkSession, f"{path}/model.json", json.dumps({"kind": model.kind, "parts": parts, "grid": grid, "perlen": list(model.perlen)}))


def load_model(spark: SparkSession, path: str):
    """What ``save_model`` wrote."""
    from thalweg.operators.overlay import Grid
    from thalweg.operators.sfr import ReachNetwork

    state = json.loads("".join(r[0] for r in spark.read.text(f"{path}/model.json").collect()))
    parts = {n: spark.read.parquet(f"{path}/{n}") for n in state["parts"]}
    grid = Grid(**{k: tuple(v) if isinstance(v, list) else v for k, v in state["grid"].items()})
    return ReachNetwork(state["kind"], load(spark, f"{path}/network"), grid, parts["reaches"], parts["segments"], parts.get("links"), parts.get("diversions"), tuple(state["perlen"]))
