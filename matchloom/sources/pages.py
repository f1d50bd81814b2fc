"""Captured pages to job rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import lexicon
from matchloom.functions.text import bind, strip
from matchloom.functions.markup import Page, Selector
from matchloom.functions.web import CardSelectors, DetailSelectors, job_id_from_url

DETAIL_FIELDS = ("title", "company", "experience", "salary", "location", "description")
CARD_FIELDS = ("title", "company", "location", "experience", "salary", "posted_date")
CARDS = ("array<struct<card_no:int,url:string,skills:array<string>,"
         + ",".join(f"{name}:string" for name in CARD_FIELDS) + ">>")
DETAILS = ("struct<title:string,company:string,description:string,spans:array<string>,"
           "skills:array<string>,pairs:array<string>>")


def _cards(selectors: CardSelectors) -> Callable[[pd.Series], pd.Series]:
    parts = {f.name: Selector(getattr(selectors, f.name)) for f in fields(selectors)}

    @F.pandas_udf(CARDS)
    def cards(pages: pd.Series) -> pd.Series:
        def of(source: str | None) -> list[dict]:
            page, out = Page(source), []
            for number, card in enumerate(page.select(parts["card"])):
                row = {name: page.first_text(parts[name], card) for name in CARD_FIELDS}
                link = page.first(parts["link"], card)
                row |= {"card_no": number, "url": link.attributes.get("href") if link else None,
                        "skills": page.all_texts(parts["skill"], card)}
                out.append(row)
            return out

        return pages.map(of, na_action=None)

    return cards


def job_cards(
    pages: DataFrame,
    scraped_at: Column,
    selectors: CardSelectors | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per job card of ``pages(html, ...)`` that has a title.

    ``keep`` names page columns to carry along; ``card_no`` is the position on the page.
    """
    found = pages.select(*keep, F.explode(_cards(selectors or CardSelectors())(F.col("html"))).alias("card"))
    card = F.col("card")

    def part(name: str, missing: str) -> Column:
        return F.coalesce(card[name], F.lit(missing)).alias(name)

    return found.where(card["title"] != "").select(
        *keep, card["card_no"].alias("card_no"), card["title"].alias("title"), card["url"].alias("url"),
        part("company", lexicon.NOT_SPECIFIED), part("location", lexicon.NOT_SPECIFIED),
        part("experience", lexicon.NOT_SPECIFIED), part("salary", lexicon.NOT_DISCLOSED),
        card["skills"].alias("skills"), part("posted_date", lexicon.NOT_SPECIFIED),
        job_id_from_url(card["url"]).alias("job_id"), scraped_at.alias("scraped_at"))


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Results of several searches, one after the other; duplicates stay.

    ``seq`` orders the rows (batch first), so that "first wins" can be decided later.
    """
    tagged = [b.withColumn("batch_no", F.lit(n)) for n, b in enumerate(batches)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def detail_key(text: Column) -> Column:
    return F.replace(F.lower(F.replace(strip(text), F.lit(":"), F.lit(""))), F.lit(" "), F.lit("_"))


def key_values(spans: Column) -> Column:
    """Map of alternating key and value texts.

    An odd tail is dropped; of repeated keys the last one stays (removed before
    the map is built, since map construction rejects duplicates).
    """

    def build(s: Column) -> Column:
        pairs = (F.size(s) / 2).cast("int")
        positions = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(
            F.array().cast("array<int>"))
        keys = F.transform(positions, lambda i: detail_key(F.get(s, i * 2)))

        def last_only(k: Column) -> Column:
            kept = F.filter(
                F.transform(k, lambda key, i: F.when(
                    ~F.array_contains(F.slice(k, i + 2, F.size(k)), key), i)),
                lambda i: i.isNotNull(),
            )
            return F.map_from_entries(F.transform(kept, lambda i: F.struct(
                F.get(k, i).alias("key"), strip(F.get(s, i * 2 + 1)).alias("value"))))

        return bind(keys, last_only)

    return bind(spans, build)


def _details(selectors: DetailSelectors) -> Callable[[pd.Series], pd.Series]:
    parts = {f.name: Selector(getattr(selectors, f.name)) for f in fields(selectors)}

    @F.pandas_udf(DETAILS)
    def details(pages: pd.Series) -> pd.Series:
        def of(source: str | None) -> dict:
            page = Page(source)
            row = {name: page.first_text(parts[name]) for name in ("title", "company", "description")}
            return row | {"spans": page.all_texts(parts["header_span"]), "skills": page.all_texts(parts["skill"]),
                          "pairs": page.all_texts(parts["detail_span"])}

        return pd.DataFrame(list(map(of, pages)), columns=["title", "company", "description", "spans", "skills", "pairs"])

    return details


def job_details(
    pages: DataFrame, selectors: DetailSelectors | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Fields of detail pages: base fields, skills, and the open keys as a map.

    An open key that equals a base field overwrites it. ``skills`` stays the list;
    an open key of that name is found in ``details`` only.
    """
    base = pages.select(*keep, _details(selectors or DetailSelectors())(F.col("html")).alias("page")).select(
        *keep, "page.*").withColumn("details", key_values(F.col("pairs")))
    spans, full_header = F.col("spans"), F.size("spans") >= 3
    for n, name in enumerate(("experience", "salary", "location")):
        base = base.withColumn(name, F.when(full_header, F.get(spans, F.lit(n))))
    found = [
        F.coalesce(F.try_element_at(F.col("details"), F.lit(name)), F.col(name)).alias(name)
        for name in DETAIL_FIELDS
    ]
    return base.select(*keep, *found, "skills", "details")
