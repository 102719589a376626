"""Readers with an explicit policy for bad input, writers, and small driver-side helpers."""

from __future__ import annotations

import json
import os
import re
import time
import zipfile
from dataclasses import dataclass, fields
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NA_TEXTS = ("NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "")
BAD = "_bad"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def read_jsonl(spark: SparkSession, path, schema: str, on_error: str = "skip", required: list[str] | None = None, defaults: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows, rejects) of JSON Lines. on_error: skip drops bad lines and rows without a
    required field; report returns them (first 200 characters) as rejects; fail raises.
    Blank lines are passed over. defaults fill missing fields."""
    if on_error == "fail":
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        for c in required or []:
            rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"missing field {c}"))))
        return _fill(rows, defaults), None
    if on_error not in ("skip", "report"):
        raise ValueError(f"on_error is skip, report or fail, not {on_error}")
    # parsed from text lines, so rejects need no cache of the source
    lines = spark.read.text(path).filter(F.trim("value") != "")
    whole = lines.select("value", F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    ok = F.col(f"r.{BAD}").isNull()
    for c in required or []:
        ok = ok & F.col(f"r.{c}").isNotNull()
    good = whole.filter(ok).select("r.*").drop(BAD)
    rejects = whole.filter(~ok).select(F.substring("value", 1, 200).alias("line")) if on_error == "report" else None
    return _fill(good, defaults), rejects


def _fill(df: DataFrame, defaults: dict | None) -> DataFrame:
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return df


def read_json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path, schema: str | None = None, na: tuple[str, ...] = (), infer: bool = False) -> DataFrame:
    """CSV with a header; without a schema all columns are strings, or of the type that all their values have with infer.

    na texts become null, before types are inferred. Inference is one aggregation over all rows.
    """
    r = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    df = (r.schema(schema) if schema else r).csv(path)
    if na:
        df = df.select([F.when(~F.col(c).isin(*na), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
    if infer and not schema:
        kinds = ("long", "double", "boolean")
        fits = df.agg(*[F.coalesce(F.bool_and(F.col(c).try_cast(k).isNotNull() | F.col(c).isNull()), F.lit(True)).alias(f"{i}{k}") for i, c in enumerate(df.columns) for k in kinds]).first()
        chosen = [next((k for k in kinds if fits[f"{i}{k}"]), "string") for i in range(len(df.columns))]
        df = df.select([F.col(c).try_cast(k).alias(c) for c, k in zip(df.columns, chosen)])
    return df


def processed_keys(spark: SparkSession, path: str, key: str, fmt: str = "json") -> DataFrame:
    """Distinct keys that a sink already holds; none when it does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.format(fmt).load(path).select(key).filter(F.col(key).isNotNull()).distinct()


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_path(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return path


def load_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def config_row(config: dict) -> dict:
    """The part of a run configuration that runners need."""
    return {"type": config["model"]["type"], "output_dir": config["training"]["output_dir"], "source_prefix": config["data"].get("source_prefix", "")}


#: The labels of an evaluation log by metric.
LOG_METRICS = {
    "style_accuracy": r"Style Accuracy \([^)]*\)\s*:\s*([0-9.]+)",
    "content_preservation": r"Content Preservation \([^)]*\)\s*:\s*([0-9.]+)",
    "fluency_perplexity": r"Linguistic Fluency \([^)]*\)\s*:\s*([0-9.]+)",
    "exact_copy_rate": r"Exact Copy Rate\s*:\s*([0-9.]+)",
    "near_copy_rate": r"Near-Copy Rate \([^)]*\)\s*:\s*([0-9.]+)",
}


def log_metrics(text: Column, required: bool = True) -> list[Column]:
    """One column for each metric of a log; a missing one is an error when required, else null."""
    out = []
    for name, pattern in LOG_METRICS.items():
        v = F.regexp_extract(text, pattern, 1)
        miss = F.raise_error(F.lit(f"could not find metric {name}")).cast("string") if required else F.lit(None).cast("string")
        out.append(F.when(v != "", v).otherwise(miss).cast("double").alias(name))
    return out


def read_logs(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", ascii_only: bool = False) -> None:
    """One object a line; ascii_only writes what is beyond ASCII as escapes."""
    if not ascii_only:
        df.write.mode(mode).json(path)
        return

    @F.pandas_udf("string")
    def escaped(lines: pd.Series) -> pd.Series:
        beyond = re.compile(r"[^\x00-\x7f]+")
        return lines.map(lambda line: beyond.sub(lambda m: json.dumps(m[0])[1:-1], line))

    df.select(escaped(F.to_json(F.struct(*df.columns))).alias("value")).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "overwrite") -> None:
    """Part files with one header each, so appending never repeats a header inside a file."""
    (df.select(*columns) if columns else df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json_document(df: DataFrame, path: str, limit: int = 100_000) -> None:
    """A small result as one pretty JSON array; more rows than limit are an error, not cut."""
    rows = [json.loads(r) for r in df.limit(limit + 1).toJSON().collect()]
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows: write JSON Lines instead")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2, ensure_ascii=False)


def write_best(df: DataFrame, score: str, path: str, tie: str) -> dict:
    row = json.loads(df.orderBy(F.desc(score), tie).limit(1).toJSON().first())
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2)
    return row


def sheet_widths(df: DataFrame) -> DataFrame:
    """Column widths that a spreadsheet export would take."""
    return df.agg(*[F.least(F.greatest(F.max(F.length(F.col(c).cast("string"))), F.lit(len(c))) + 4, F.lit(60)).alias(c) for c in df.columns])


def write_xlsx(df: DataFrame, path: str, limit: int = 100_000) -> None:
    """A small result as a spreadsheet: bold header, columns as wide as sheet_widths says, rows 15 points high.

    More rows than limit are an error, not cut. Written with the standard library.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows: write CSV instead")
    widths = [min(max(len(c), *(len(str(r[c])) for r in rows if r[c] is not None), 0) + 4, 60) for c in df.columns]

    def cell(v, style: int) -> str:
        if v is None:
            return f'<c s="{style}"/>'
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f'<c s="{style}"><v>{v}</v></c>'
        return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(v)))}</t></is></c>'

    line = lambda values, style: '<row ht="15" customHeight="1">' + "".join(cell(v, style) for v in values) + "</row>"
    main, head = "http://schemas.openxmlformats.org/", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    font = "<font>%s<sz val=\"11\"/><name val=\"Calibri\"/></font>"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{main}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{main}package/2006/relationships"><Relationship Id="rId1" Type="{main}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{main}package/2006/relationships"><Relationship Id="rId1" Type="{main}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{main}officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}spreadsheetml/2006/main" xmlns:r="{main}officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}spreadsheetml/2006/main"><fonts count="2">{font % ""}{font % "<b/>"}</fonts><fills count="1"><fill><patternFill patternType="none"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf fontId="0"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}spreadsheetml/2006/main"><cols>{cols}</cols><sheetData>{line(df.columns, 1)}{"".join(line(r, 0) for r in rows)}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, head + body)


def require_model(path: str, fetch=None) -> str:
    """The folder of a model that is there already, else what fetch() makes of it; without fetch an error."""
    if os.path.isdir(path) and os.listdir(path):
        return path
    if fetch is None:
        raise FileNotFoundError(f"no model in {path}")
    fetch(path)
    return path


def output_name(model_path: str, suffix: str) -> str:
    """Name of a result file: the parent's name when the leaf is final or checkpoint-*."""
    parts = os.path.normpath(model_path).split(os.sep)
    leaf = parts[-2] if len(parts) > 1 and (parts[-1] == "final" or parts[-1].startswith("checkpoint-")) else parts[-1]
    return f"{leaf}{suffix}"


def run_dir(base: str, run_name: str | None = None, auto_suffix: bool = False) -> str:
    if run_name:
        return f"{base}_{run_name}"
    return f"{base}_{time.strftime('%Y%m%d_%H%M%S')}" if auto_suffix else base


def prompt_prefix(explicit: str | None, model_path: str, default: str) -> str:
    """Explicit prefix, else the default for a model whose name says t5, else none."""
    if explicit is not None:
        return explicit
    return default if "t5" in os.path.basename(os.path.normpath(model_path)).lower() else ""


def check_pairs_request(save_pairs: bool, candidates: int) -> None:
    if save_pairs and candidates < 2:
        raise ValueError("preference pairs need more than one candidate")


def format_table(rows: list[dict], columns: list[str]) -> str:
    """Padded console table, numbers with 4 decimals."""
    cells = [columns, *[[f"{float(r[c]):.4f}" if re.fullmatch(r"-?\d+(\.\d+)?", str(r[c])) else str(r[c]) for c in columns] for r in rows]]
    width = [max(len(x[i]) for x in cells) for i in range(len(columns))]
    return "\n".join("  ".join(x[i].ljust(width[i]) for i in range(len(columns))).rstrip() for x in cells)


def report(row: dict, templates: list[tuple[str, int]] = ()) -> str:
    """Evaluation report with fixed labels and 4 decimals."""
    out = [f"{k.replace('_', ' ').title():<28}: {v:.4f}" if isinstance(v, float) else f"{k.replace('_', ' ').title():<28}: {v}" for k, v in row.items()]
    return "\n".join([*out, *[f"  {n:>6}  {t}" for t, n in templates]])


def parse_list(value: str, cast=str) -> list:
    return [cast(x.strip()) for x in value.split(",") if x.strip()]


@dataclass
class RunSettings:
    """Runner settings; environment variables of the same upper-case name override."""

    candidates: int = 8
    strategy: str = "sample"
    style_weight: float = 2.0
    similarity_weight: float = 1.0
    copy_weight: float = 1.5
    fluency_weight: float = 0.15
    margin: float = 0.1
    pair_mode: str = "best_vs_worst"
    seed: int = 42

    @classmethod
    def from_env(cls, env=os.environ) -> RunSettings:
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[f.type](env[f.name.upper()]) for f in fields(cls) if env.get(f.name.upper())})


def baseline_matrix(flags: dict[str, bool]) -> list[str]:
    """Runs of the four-way comparison in order; a rerank or preference run needs its base."""
    order = [("sft", []), ("sft_rerank", ["sft"]), ("dpo", ["sft"]), ("dpo_rerank", ["sft", "dpo"])]
    chosen = {n for n, _ in order if flags.get(n, True)}
    return [n for n, needs in order if n in chosen and all(x in chosen or flags.get(f"have_{x}") for x in needs)]


def ablation_grid(spark: SparkSession, configs: list[str], strategies: list[str]) -> DataFrame:
    a, b = spark.createDataFrame([(c,) for c in configs], "config string"), spark.createDataFrame([(s,) for s in strategies], "strategy string")
    return a.crossJoin(F.broadcast(b))
