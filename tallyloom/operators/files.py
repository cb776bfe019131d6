"""Inventories of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Categories of files by suffix.
CATEGORIES = {
    "文档_Documents": (".doc", ".docx", ".pdf", ".txt", ".rtf", ".odt", ".md", ".wps", ".pages"),
    "表格_Spreadsheets": (".xls", ".xlsx", ".xlsm", ".csv", ".ods", ".et"),
    "演示_Presentations": (".ppt", ".pptx", ".odp", ".dps", ".key"),
    "图片_Images": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".svg", ".heic"),
    "音频_Audio": (".mp3", ".wav", ".flac", ".aac", ".m4a", ".wma", ".ogg"),
    "视频_Video": (".mp4", ".avi", ".mkv", ".mov", ".wmv", ".flv", ".webm", ".m4v"),
    "压缩包_Archives": (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz"),
    "程序_Code": (".py", ".js", ".ts", ".java", ".c", ".cpp", ".cs", ".go", ".rs", ".php", ".rb", ".sh", ".ps1", ".sql", ".html", ".css", ".json", ".xml", ".yml", ".yaml"),
    "可执行_Executables": (".exe", ".msi", ".bat", ".cmd", ".app", ".dmg", ".apk"),
    "字体_Fonts": (".ttf", ".otf", ".woff", ".woff2", ".fon"),
    "电子书_eBooks": (".epub", ".mobi", ".azw3", ".djvu"),
}
OTHER = "其他_Other"


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def category(name: Column) -> Column:
    out = None
    for label, ends in CATEGORIES.items():
        hit = suffix(name).isin(*ends)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(OTHER)


def by_category(files: DataFrame) -> DataFrame:
    """(category, files, bytes) of files (name, bytes)."""
    return files.groupBy(category(F.col("name")).alias("category")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def by_suffix(files: DataFrame, n: int = 30) -> DataFrame:
    return files.groupBy(suffix(F.col("name")).alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).orderBy(F.desc("files"), "suffix").limit(n)


def top_suffixes(files: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent suffixes of each category; ranks are over one row a suffix."""
    each = files.groupBy(category(F.col("name")).alias("category"), suffix(F.col("name")).alias("suffix")).agg(F.count(F.lit(1)).alias("files"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("files"), "suffix"))).filter(F.col("rank") <= n)


def duplicates(files: DataFrame, quick: str, digest: str) -> DataFrame:
    """(digest, files, bytes, wasted) of files that are the same; empty ones aside.

    Two stages: a cheap key first, and only files whose cheap key collides are held against each other by the digest of all bytes.
    """
    some = files.filter("bytes > 0")
    met = some.groupBy(quick).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(quick)
    got = some.join(met, quick, "left_semi").groupBy(digest).agg(F.count(F.lit(1)).alias("files"), F.max("bytes").alias("bytes")).filter("files > 1")
    return got.withColumn("wasted", F.col("bytes") * (F.col("files") - 1))


def kept(files: DataFrame, digest: str, policy: str = "oldest") -> DataFrame:
    """Files with `keep`: of each group of equal ones the oldest, newest, or that with the shortest or longest path."""
    order = {"oldest": [F.col("modified"), F.col("path")], "newest": [F.desc("modified"), F.col("path")], "shortest-path": [F.length("path"), F.col("path")], "longest-path": [F.desc(F.length("path")), F.col("path")]}[policy]
    return files.withColumn("keep", F.row_number().over(Window.partitionBy(digest).orderBy(*order)) == 1)


def bucket(by: str) -> Column:
    """The folder a file is put in: by type, date, year-month, extension or first letter; columns name, modified."""
    return {
        "type": category(F.col("name")), "date": F.date_format("modified", "yyyy-MM-dd"), "year-month": F.date_format("modified", "yyyy-MM"),
        "extension": F.coalesce(F.nullif(F.substring(suffix(F.col("name")), 2, 20), F.lit("")), F.lit("none")), "first-letter": F.upper(F.substring("name", 1, 1)),
    }[by]


def stale(files: DataFrame, at: str, days: int) -> DataFrame:
    return files.filter(F.datediff(F.lit(at).cast("date"), F.col("modified")) > days)


def human_bytes(c: Column) -> Column:
    unit = F.when(c < 1024, 0).when(c < 1024**2, 1).when(c < 1024**3, 2).when(c < 1024**4, 3).otherwise(4)
    return F.concat(F.format_number(c / F.pow(F.lit(1024.0), unit), 1), F.element_at(F.array(*map(F.lit, (" B", " KB", " MB", " GB", " TB"))), unit + 1))


def extremes(files: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The n oldest, newest or largest files (path, bytes, modified), the path deciding among equals."""
    first = {"oldest": F.asc("modified"), "newest": F.desc("modified"), "largest": F.desc("bytes")}[by]
    return files.filter("modified is not null" if by != "largest" else "bytes is not null").orderBy(first, "path").limit(n)


def listing(files: DataFrame, limit: int = 200) -> DataFrame:
    """The newest files with `truncated`, whether there are more than `limit`. One more than the limit is read to tell."""
    some = files.orderBy(F.desc("modified"), "path").limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(F.desc("modified"), "path")))
    return some.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit).filter(F.col("place") <= limit).drop("place")
