"""File scans and sinks of a corpus."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = "{py,ipynb,md,markdown,html,htm,json,csv,tsv,txt,epub}"


def scan(spark: SparkSession, path: str, max_mb: int = 64) -> DataFrame:
    """Files below a path by extension: path, length, modificationTime, content; hidden and oversized ones left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{EXTENSIONS}").load(path)
    return f.where((F.col("length") <= max_mb * 1024 * 1024) & ~F.col("path").rlike(r"/\.[^/]*$"))


def texts(files: DataFrame) -> DataFrame:
    """(path, text): content decoded as UTF-8, bad bytes replaced one by one."""

    @F.pandas_udf("string")
    def decode(content: pd.Series) -> pd.Series:
        return content.map(lambda c: None if c is None else bytes(c).decode("utf-8", "replace"))

    return files.select("path", decode("content").alias("text"))


def csv_text(content: str, separator: str) -> str:
    """One line for each row: named cells that are not empty; the first row names them."""
    import csv

    rows = list(csv.reader(io.StringIO(content), delimiter=separator))
    if not rows:
        return ""
    names = [h.strip() or str(k) for k, h in enumerate(rows[0])]
    lines = ["; ".join(f"{names[k] if k < len(names) else k}: {c.strip()}" for k, c in enumerate(r) if c.strip()) for r in rows[1:]]
    return "\n".join(x for x in lines if x) if len(rows) > 1 else "; ".join(rows[0])


def json_text(content: str) -> str:
    """One line for each leaf with its path; what is no JSON stays as it is; lines of JSON one after the other."""

    def leaves(x: object, path: str) -> Iterator[str]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from leaves(v, f"{path}.{k}" if path else str(k))
        elif isinstance(x, list):
            for k, v in enumerate(x):
                yield from leaves(v, f"{path}.{k}" if path else str(k))
        elif x is not None:
            yield f"{path}: {x}" if path else str(x)

    try:
        return "\n".join(leaves(json.loads(content), ""))
    except ValueError:
        try:
            return "\n".join(y for x in content.splitlines() if x.strip() for y in leaves(json.loads(x), ""))
        except ValueError:
            return content


def front_matter(content: str) -> tuple[str, dict[str, str]]:
    """(text without its front matter, the simple keys of it)."""
    import re

    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?", content, re.DOTALL)
    if not m:
        return content, {}
    pairs = (x.split(":", 1) for x in m.group(1).splitlines() if ":" in x and not x.startswith((" ", "\t", "#")))
    return content[m.end() :], {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def epub_metadata(content: bytes) -> dict[str, str]:
    """Dublin Core fields of the package; several values of one field are joined."""
    import html
    import re

    out: dict[str, list[str]] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for n in z.namelist():
            if n.endswith(".opf"):
                for field, value in re.findall(r"<dc:(\w+)[^>]*>(.*?)</dc:\1>", z.read(n).decode("utf-8", "replace"), re.DOTALL):
                    out.setdefault(field, []).append(html.unescape(value.strip()))
    return {k: "; ".join(v) for k, v in out.items()}


def extract(files: DataFrame) -> DataFrame:
    """(path, text, metadata) of scanned files by their extension; a file that can't be read gives a null text."""

    def one(path: str, c: bytes) -> tuple[str | None, dict[str, str]]:
        name = path.lower()
        if name.endswith(".epub"):
            return epub_text(path, c), epub_metadata(c)
        if name.endswith(".py"):
            return python_text(path, c), {}
        t = c.decode("utf-8", "replace")
        if name.endswith((".csv", ".tsv")):
            return csv_text(t, "\t" if name.endswith(".tsv") else ","), {}
        if name.endswith(".json"):
            return json_text(t), {}
        if name.endswith((".md", ".markdown")):
            return front_matter(t)
        if name.endswith((".html", ".htm")):
            from corpusloom.sources.html import parse_page

            p = parse_page(t, "")
            return p["text"], {"title": p["title"] or "", **p["meta"]}
        return t, {}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, c in zip(part["path"], part["content"], strict=True):
                try:
                    rows.append((p, *one(p, bytes(c))))
                except Exception:  # one bad file must not stop the scan
                    rows.append((p, None, {}))
            yield pd.DataFrame(rows, columns=["path", "text", "metadata"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, metadata map<string,string>")


def extract_with(files: DataFrame, parse, schema: str = "path string, text string") -> DataFrame:
    """Plug-in interface: ``parse(path, content) -> text`` runs per Arrow batch; a failing file gives null."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, c in zip(part["path"], part["content"], strict=True):
                try:
                    rows.append((p, parse(p, bytes(c))))
                except Exception:  # one bad file must not stop the scan
                    rows.append((p, None))
            yield pd.DataFrame(rows, columns=["path", "text"])

    return files.select("path", "content").mapInPandas(run, schema)


def epub_text(path: str, content: bytes) -> str:
    """Chapters of an EPUB in name order, tags stripped."""
    import re

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [z.read(n).decode("utf-8", "replace") for n in sorted(z.namelist()) if n.endswith((".xhtml", ".html", ".htm"))]
    return "\n\n".join(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", p)).strip() for p in parts)


def python_text(path: str, content: bytes) -> str:
    """Imports, then docstring and name of each top-level definition; 50-line chunks when it does not parse."""
    import ast

    src = content.decode("utf-8", "replace")
    try:
        tree = ast.parse(src)
    except SyntaxError:
        lines = src.split("\n")
        return "\n\n".join("\n".join(lines[a : a + 50]) for a in range(0, len(lines), 50))
    out = [ast.unparse(n) for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    out += [f"{n.name}: {ast.get_docstring(n) or ''}\n{ast.unparse(n)}" for n in tree.body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
    return "\n\n".join(out)


def metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON metadata files with a given schema; broken ones keep their text in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).json(path)


def write_routed(df: DataFrame, path: str, flag: str = "quality_flag") -> None:
    """Parquet by bucket: low_quality or extracted."""
    bucket = F.when(F.col(flag) == "low_quality", "low_quality").otherwise("extracted")
    df.withColumn("quality_bucket", bucket).write.mode("overwrite").partitionBy("quality_bucket").parquet(path)


def write_actions(df: DataFrame, path: str) -> None:
    """Append to a log of JSON lines."""
    df.write.mode("append").json(path)


def export(df: DataFrame, path: str, version: str, dry_run: bool = False) -> dict:
    """Parquet export by domain with a manifest; the manifest is aggregated, only its few rows reach the driver."""
    rows = df.groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("files")).collect()
    manifest = {"version": version, "domains": {r["domain"]: r["files"] for r in sorted(rows, key=lambda r: r["domain"])}}
    if not dry_run:
        df.write.mode("errorifexists").partitionBy("domain").parquet(path)
        df.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_manifest")
    return manifest


def free_name(folder: str, name: str) -> str:
    """Path of a name in a folder that is not taken, with _1, _2 and so on before its extension."""
    import os

    stem, ext = os.path.splitext(name)
    path, k = os.path.join(folder, name), 0
    while os.path.exists(path):
        k += 1
        path = os.path.join(folder, f"{stem}_{k}{ext}")
    return path


def zip_export(folder: str, target: str, manifest: dict) -> str:
    """One archive of an exported folder with its manifest, written file by file (local file systems)."""
    import os

    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("manifest.json", json.dumps(manifest, sort_keys=True))
        for base, _, names in sorted(os.walk(folder)):
            for n in sorted(names):
                if not n.startswith((".", "_")):
                    z.write(os.path.join(base, n), os.path.relpath(os.path.join(base, n), folder))
    return target


def move_plan(df: DataFrame, root: str, path_col: str = "path", domain_col: str = "domain") -> DataFrame:
    """(path, target): where each file goes, by domain; names that meet get a number, in the order of their paths. Nothing is moved."""
    from pyspark.sql import Window

    name = F.element_at(F.split(F.col(path_col), "/"), -1)
    base = F.concat_ws("/", F.lit(root.rstrip("/")), F.coalesce(F.col(domain_col), F.lit("unknown")), name)
    k = F.row_number().over(Window.partitionBy("_t").orderBy(path_col)) - 1
    numbered = df.select(F.col(path_col).alias("path"), base.alias("_t")).withColumn("_k", k.cast("string"))
    return numbered.select("path", F.when(F.col("_k") == "0", F.col("_t")).otherwise(F.regexp_replace("_t", r"^(.*?)(\.[^./]*)?$", F.concat(F.lit("$1_"), F.col("_k"), F.lit("$2")))).alias("target"))
