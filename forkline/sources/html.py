"""Book pages: nodes, choices and tagged paragraphs from HTML.

The scan is distributed (one row a page); pages are parsed with the standard library in Arrow
batches, as nesting (direct children of the main text) is beyond regular expressions. Everything
after the parse is Column expressions. ``flat_*`` are native forms for pages without nesting.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forkline import schemas

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PARSED = "page_id string, has_main boolean, paragraphs array<string>, deadend boolean, combats array<string>, images array<string>, choices array<struct<text string, links int, hrefs array<string>>>"


class _Page(HTMLParser):
    """Collects what the node and choice tables need from one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.main: int | None = None
        self.done = False
        self.open: list[tuple[int, str, list[str], dict | None]] = []
        self.paragraphs: list[str] = []
        self.combats: list[str] = []
        self.images: list[str] = []
        self.choices: list[dict] = []
        self.deadend = False

    def inside(self) -> bool:
        return self.main is not None and not self.done

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        kind = values.get("class", "")
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.handle_endtag("p")
        if tag not in VOID:
            self.stack.append((tag, kind))
        depth = len(self.stack)
        if self.main is None:
            if tag == "div" and "maintext" in kind:
                self.main = depth
            return
        if self.done:
            return
        if tag == "img" and "src" in values:
            self.images.append(values["src"])
        if tag == "a" and self.open and self.open[-1][3] is not None:
            self.open[-1][3]["links"] += 1
            if "href" in values:
                self.open[-1][3]["hrefs"].append(values["href"])
        if tag == "p":
            classes = kind.split()
            choice = {"text": "", "links": 0, "hrefs": []} if "choice" in classes else None
            self.deadend |= "deadend" in classes
            role = "choice" if choice is not None else "combat" if "combat" in classes else "p"
            direct = depth == self.main + 1 and classes != ["choice"]
            self.open.append((depth, role + ("+" if direct else ""), [], choice))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        for _, _, parts, _ in self.open:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            depth, (name, _) = len(self.stack), self.stack[-1]
            if self.open and self.open[-1][0] == depth:
                _, role, parts, choice = self.open.pop()
                text = "".join(parts).replace("\xa0", " ")
                if role.endswith("+"):
                    self.paragraphs.append(text)
                if choice is not None:
                    self.choices.append(choice | {"text": text})
                if role.startswith("combat"):
                    self.combats.append("".join(p.strip() for p in parts).replace("\xa0", " "))
            if self.main == depth:
                self.done = True
            self.stack.pop()
            if name == tag:
                return


def parse_page(html: str) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    return {"has_main": page.main is not None, "paragraphs": page.paragraphs, "deadend": page.deadend, "combats": page.combats, "images": page.images, "choices": page.choices}


def scan_pages(spark: SparkSession, folder: str, pattern: str = "sect*.htm") -> DataFrame:
    """(page_id, html): one row a file, the id from its name."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"sect([^/]*)\.htm$", 1)
    return raw.select(name.alias("page_id"), F.col("value").alias("html"))


def parse_pages(pages: DataFrame) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            yield pd.DataFrame([{"page_id": i, **parse_page(h)} for i, h in zip(b["page_id"], b["html"], strict=True)], columns=[c.split()[0] for c in ("page_id", "has_main", "paragraphs", "deadend", "combats", "images", "choices")])

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "html").mapInPandas(run, PARSED)


def target_of(links: Column, hrefs: Column) -> Column:
    """The page a choice leads to: its first link to a page; null where there is none."""
    first = F.get(F.filter(hrefs, lambda h: h.contains("sect")), F.lit(0))
    one = F.when(F.get(hrefs, F.lit(0)).contains("sect"), F.get(hrefs, F.lit(0)))
    return F.replace(F.replace(F.when(links > 1, first).otherwise(one), F.lit("sect"), F.lit("")), F.lit(".htm"), F.lit(""))


def choices(parsed: DataFrame) -> DataFrame:
    """(source_id, position, target_id, edge_text): choices with at least one address."""
    rows = parsed.where("has_main").select(F.col("page_id").alias("source_id"), F.posexplode("choices").alias("position", "c"))
    return rows.where(F.size("c.hrefs") > 0).select("source_id", "position", target_of(F.col("c.links"), F.col("c.hrefs")).alias("target_id"), F.col("c.text").alias("edge_text"))


def narrative() -> Column:
    return F.array_join("paragraphs", " ")


def tagged_paragraphs(parsed: DataFrame) -> DataFrame:
    """(id, text): the narrative followed by each choice between tags, by numeric id."""
    kept = F.filter("choices", lambda c: F.size(c["hrefs"]) > 0)
    tags = F.array_join(F.transform(kept, lambda c: F.concat(F.lit(" <choice>"), c["text"], F.lit("</choice>"))), "")
    return parsed.where("has_main").select(F.col("page_id").alias("id"), F.concat(narrative(), tags).alias("text")).orderBy(F.expr("try_cast(id AS bigint)"), "id")


def enemy_of(text: Column) -> Column:
    pattern = r"(.*?):\s*COMBAT\s*SKILL\s*(\d+)\s*ENDURANCE\s*(\d+)"
    part = lambda k: F.regexp_extract(text, pattern, k)
    found = F.struct(F.trim(part(1)).alias("name"), part(2).try_cast("int").alias("cs"), part(3).try_cast("int").alias("ep"))
    return F.when(text.rlike(pattern), found)


def health_modifier(text: Column) -> Column:
    """Points gained less points lost, by the first mention of each."""
    points = lambda verb: F.coalesce(F.regexp_extract(text, rf"{verb}\s+(\d+)\s+ENDURANCE", 1).try_cast("int"), F.lit(0))
    return points("gain") - points("lose")


def nodes(parsed: DataFrame, pages: int | None = None) -> DataFrame:
    """The node table; the page whose id is the number of pages wins."""
    n = pages if pages is not None else parsed.count()
    enemies = F.filter(F.transform("combats", enemy_of), lambda e: e.isNotNull())
    health = health_modifier(narrative())
    status = F.when(F.col("deadend"), "death").when(F.size("combats") > 0, "potential_death").when(F.col("page_id") == str(n), "win").otherwise("none")
    rows = parsed.where("has_main").select(
        F.col("page_id").alias("node_id"),
        narrative().alias("text_content"),
        F.when(health < 0, "potential_death").otherwise(status).alias("absorbing_status"),
        F.when(F.size(enemies) > 0, F.to_json(enemies)).alias("enemies"),
        health.cast("int").alias("health_modifier"),
        F.lit(None).cast("string").alias("special_mechanic"),
        F.when(F.size("images") > 0, F.array_join("images", ",")).alias("image_refs"),
        F.lit(None).cast("string").alias("items_granted"),
    )
    return rows.select(*(F.col(f.name).cast(f.dataType) for f in schemas.NODES.fields)).orderBy(F.expr("try_cast(node_id AS bigint)"), "node_id")


def simple_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, text_content) and edges (source_id, target_id, edge_text) without annotation, in numeric order."""
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    own = parsed.where("has_main").select(F.col("page_id").alias("node_id"), narrative().alias("text_content"))
    edges = choices(parsed).where("target_id IS NOT NULL").select("source_id", "target_id", "edge_text")
    return own.orderBy(number("node_id"), "node_id"), edges.orderBy(number("source_id"), number("target_id"), "edge_text")


def skipped(parsed: DataFrame) -> DataFrame:
    """Pages without a main text and choices without an address, for the log."""
    pages = parsed.where("not has_main").select("page_id", F.lit("no main text").alias("problem"))
    lost = parsed.select("page_id", F.explode("choices").alias("c")).where(F.size("c.hrefs") == 0)
    dangling = choices(parsed).where("target_id IS NULL").select(F.col("source_id").alias("page_id"), F.lit("choice without page").alias("problem"))
    return pages.unionAll(lost.select("page_id", F.lit("choice without address").alias("problem"))).unionAll(dangling)


def flat_hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))


def flat_text(html: Column) -> Column:
    """Text of a fragment without nesting: tags dropped, the five basic entities and NBSP decoded."""
    text = F.regexp_replace(html, r"<[^>]*>", "")
    for name, plain in (("&nbsp;", " "), ("\u00a0", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(plain))
    return text


def page_schema() -> T.StructType:
    return T.StructType([T.StructField("page_id", T.StringType()), T.StructField("html", T.StringType())])
