"""Small files and folders on whatever file system the session uses: settings, reports, and folders for a query's own tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder; where none is set, on a local master only, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\[\]-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.gettempdir()
    return f"{named}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_file(spark: SparkSession, path: str, content: str | bytes) -> str:
    """A file of the driver's, such as a report."""
    system, where = _place(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(content.encode() if isinstance(content, str) else content))
    finally:
        out.close()
    return path


def read_file(spark: SparkSession, path: str) -> str:
    """A small text file, such as settings."""
    return spark.read.text(path, wholetext=True).first()[0]


def remove(spark: SparkSession, path: str) -> None:
    system, where = _place(spark, path)
    system.delete(where, True)


def _value(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    if text.startswith("["):
        return [_value(t) for t in text[1:-1].split(",") if t.strip()]
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_settings(text: str) -> dict:
    """Settings of two levels: ``key: value`` lines, indented ones under ``section:``; the rest of a line after # is a comment, but in quotes."""
    out: dict = {}
    section = out
    for line in text.splitlines():
        found = re.match(r"""(\s*)([\w-]+)\s*:\s*((?:"[^"]*"|'[^']*'|\[[^\]]*\]|[^#])*?)\s*(?:\#.*)?$""", line)
        if not found:
            continue
        indent, key, value = found.groups()
        if not indent:
            section = out
        if value:
            section[key] = _value(value)
        elif not indent:
            section = out.setdefault(key, {})
    return out


def read_settings(spark: SparkSession, path: str) -> dict:
    return parse_settings(read_file(spark, path))
