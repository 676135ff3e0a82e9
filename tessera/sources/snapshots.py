"""Snapshot readers and writers (S1-S13, K1-K8 of the survey): Parquet, CSV, JSON lines, saved pages, archives, folders."""

from __future__ import annotations

import html
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import listing as L
from tessera.operators.relational import keep_last, snapshot_key
from tessera.sources import raw

SUPPORTED = (".parquet", ".csv", ".jsonl", ".ndjson", ".html", ".htm", ".zip")
RAW = "card string, detail string, crawl_transport string, crawl_error string"


def supported(path: str) -> str:
    """The suffix of a path; ValueError with the supported set for others."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in SUPPORTED:
        raise ValueError(f"{path}: unsupported format {suffix!r}; supported are {', '.join(SUPPORTED)}")
    return suffix


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S3: header, quoted line breaks, doubled quotes; a byte-order mark is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(card, detail, crawl_transport, crawl_error, source, line) of non-blank lines, fields as JSON texts.

    A line that is no JSON object raises with its file when ``strict``, else it is left out.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>"))
    if strict:
        parsed = parsed.withColumn("v", F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("no JSON object in "), "source")).cast("map<string,variant>")).otherwise(F.col("v")))
    parsed = parsed.where("v is not null")
    return parsed.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("card", "detail", "crawl_transport", "crawl_error")], "source", "line")


_STATE = re.compile(r"(?:window\.)?__PRELOADED_STATE__\s*=\s*")
_LD = re.compile(r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.DOTALL | re.IGNORECASE)


def preloaded_state(document: str) -> dict | None:
    """The first JSON object after the assignment, whatever follows it."""
    found = _STATE.search(document)
    if not found:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(document, found.end())
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def token_of(url: object) -> str | None:
    """The last path segment of an address, if it is a valid token."""
    last = str(url or "").split("?")[0].split("#")[0].rstrip("/").rsplit("/", 1)[-1]
    return last if re.fullmatch(L.TOKEN_PATTERN.strip("^$"), last) else None


def _objects(value) -> Iterator[dict]:
    """Objects of a small document in order, without recursion."""
    waiting = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, dict):
            yield x
        waiting += reversed(list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else ())


def linked_data(document: str) -> dict[str, dict]:
    """JSON-LD objects by token of their address; later ones win, broken scripts are skipped."""
    out = {}
    for script in _LD.findall(document):
        try:
            value = json.loads(html.unescape(script))
        except ValueError:
            continue
        for node in _objects(value):
            if token := token_of(node.get("url")):
                out[token] = node
    return out


def page_cards(document: str) -> list[dict]:
    """Records of a saved search page, first occurrence of each token."""
    state = preloaded_state(document) or {}
    widgets = next((n["listWidgets"] for n in _objects(state) if isinstance(n.get("listWidgets"), list)), [])
    details, out, seen = linked_data(document), [], set()
    for w in widgets:
        data = w
        for key in ("data", "dto", "data"):
            data = data.get(key) if isinstance(data, dict) else None
        action = (data or {}).get("action")
        payload = action.get("payload") if isinstance(action, dict) else None
        token = str((payload or {}).get("token") or "")
        if not re.fullmatch(L.TOKEN_PATTERN.strip("^$"), token) or token in seen:
            continue
        seen.add(token)
        place, detail = payload.get("web_info") or {}, details.get(token, {})
        card = {"token": token, "title": data.get("title"), "subtitle": data.get("middle_description_text"), "bottom_text": data.get("bottom_description_text"), "deposit_text": data.get("top_description_text"),
                "rent_text": data.get("middle_description_text"), "district": place.get("district_persian"), "city": place.get("city_persian"), "url": detail.get("url")}
        out.append({"card": card, "detail": detail, "crawl_transport": "html"})
    return out


def _records(name: str, content: bytes) -> list[tuple]:
    text = content.decode("utf-8", errors="replace").lstrip("﻿")
    if name.lower().endswith((".html", ".htm")):
        found = page_cards(text)
    else:
        found = []
        for line in text.splitlines():
            if line.strip():
                value = json.loads(line)
                if not isinstance(value, dict):
                    raise ValueError(f"{name}: no JSON object")
                found.append(value)
    return [(json.dumps(r.get("card") or {}, ensure_ascii=False), json.dumps(r.get("detail") or {}, ensure_ascii=False), r.get("crawl_transport"), r.get("crawl_error")) for r in found]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of saved pages and of archives of pages and JSON lines, members in order of name; one file is one task's unit."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                if source.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members = sorted(m for m in z.namelist() if m.lower().endswith((".html", ".htm", ".jsonl", ".ndjson")) and "/" not in m.strip("/"))
                        if not members:
                            raise ValueError(f"{source}: no supported member")
                        for m in members:
                            rows += _records(m, z.read(m))
                else:
                    rows = _records(source, content)
                columns = list(zip(*rows)) or [(), (), (), ()]
                arrays = [pa.array(c, pa.string()) for c in columns] + [pa.array([source] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["card", "detail", "crawl_transport", "crawl_error", "source", "line"])

    return files.mapInArrow(run, RAW + ", source string, line long")


def dom_cards(anchors: DataFrame) -> DataFrame:
    """Cards of anchor rows (ord, href, title, text), first occurrence of each token."""
    text, lines = F.coalesce("text", F.lit("")), F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    heading = F.try_element_at(F.filter(lines, lambda x: (F.length(x) >= 4) & ~x.rlike("تومان|پیش|دقیقه|ساعت|روز")), F.lit(1))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), heading)
    plain = L.fa_to_en(F.concat_ws("\n", title, text))
    area = F.regexp_extract(plain, r"(?<![0-9])([0-9]{2,4})\s*متر", 1).try_cast("int")
    rooms = F.coalesce(F.regexp_extract(plain, r"(?<![0-9])([0-9]{1,2})\s*(?:خواب|اتاق)", 1).try_cast("int"), F.when(F.contains(plain, F.lit("بدون اتاق")), 0), *[F.when(F.contains(plain, F.lit(f"{w} خواب")), n) for w, n in list(L.ROOM_WORDS.items())[:4]])

    def with_any(*needles: str):
        return F.try_element_at(F.filter(lines, lambda x: x.rlike("|".join(needles))), F.lit(1))

    token = F.regexp_extract(F.regexp_replace(F.coalesce("href", F.lit("")), r"[?#].*$", ""), r"([^/]+)/?$", 1)
    cards = anchors.select("ord", token.alias("token"), title.alias("title"), text.alias("description_hint"), area.alias("area_hint"), rooms.alias("rooms_hint"), with_any("ودیعه", "رهن").alias("deposit_text"), with_any("اجاره").alias("rent_text"))
    first = cards.where(F.col("token").rlike(L.TOKEN_PATTERN)).groupBy("token").agg(F.min_by(F.struct(*[c for c in cards.columns if c != "token"]), "ord").alias("c"))
    return first.select("token", "c.*")


# Room counts in words, as partners send them.
PARTNER_ROOMS = {"بدون اتاق": 0, "یک": 1, "دو": 2, "سه": 3, "چهار": 4, "پنج": 5, "شش": 6}


def partner_rooms(value):
    """a room word as its number, anything else parsed."""
    words = F.create_map(*[F.lit(x) for pair in PARTNER_ROOMS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, F.trim(value)).cast("double"), L.parse_number(value))


def load_snapshot(spark: SparkSession, path: str, redact: bool = True) -> DataFrame:
    """Listings of a file or of the supported files of a folder (not below it), by name, the last of each key kept."""
    if os.path.isdir(path):
        files = sorted(os.path.join(path, f) for f in os.listdir(path) if os.path.splitext(f)[1].lower() in SUPPORTED)
        if not files:
            raise ValueError(f"{path}: no supported file; supported are {', '.join(SUPPORTED)}")
    else:
        files = [path]
    out = None
    for i, f in enumerate(files):
        suffix = supported(f)
        if suffix == ".parquet":
            part = read_parquet(spark, f).withColumn("_line", F.monotonically_increasing_id())
        elif suffix == ".csv":
            part = read_csv(spark, f).withColumn("_line", F.monotonically_increasing_id())
        else:
            records = read_jsonl(spark, f) if suffix in (".jsonl", ".ndjson") else read_pages(spark, f)
            part = raw.normalize(records, "line", redact).withColumnRenamed("line", "_line")
        part = part.withColumn("_file", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    for c in ("token", "url"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return keep_last(out, snapshot_key(out.drop("_file", "_line")), ["_file", "_line"]).drop("_file", "_line")


def write_jsonl(df: DataFrame, path: str) -> None:
    """K1, K8: one JSON object for each row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K2: header, quoted texts."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """K5."""
    df.write.mode("overwrite").parquet(path)


def run_summary(scored: DataFrame) -> dict:
    """Rows and counts by band."""
    bands = {r["risk_band"]: r["n"] for r in scored.groupBy("risk_band").agg(F.count("*").alias("n")).collect()}  # three bands
    return {"rows": sum(bands.values()), "bands": bands}


def html_report(scored: DataFrame, path: str, top: int = 100) -> None:
    """K7: band counts, score histogram and the most urgent rows as one self-contained page."""
    from tessera.operators.relational import histogram

    s, bars = run_summary(scored), {r["bin"]: r["n"] for r in histogram(scored, "review_priority_score", 0.0, 1.0, 25).collect()}
    rows = scored.orderBy(F.desc("review_priority_score"), "listing_id").limit(top).select("listing_id", "risk_band", F.round("review_priority_score", 3).alias("score"), "flag_reasons").collect()
    highest = max(bars.values(), default=1)
    svg = "".join(f'<rect x="{12 * b}" y="{100 - 100 * n / highest:.1f}" width="10" height="{100 * n / highest:.1f}"/>' for b, n in sorted(bars.items()))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    page = f"<!doctype html><meta charset=utf-8><title>Report</title><p>{html.escape(json.dumps(s))}</p><svg width=300 height=100>{svg}</svg><table>{body}</table>"
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
