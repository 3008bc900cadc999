"""Web pages: posting fields and posting links out of HTML."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class FieldSelectors:
    """Tag and class text of the three fields. The shape of a posting page."""

    title: tuple[str, str] = ("h1", "top-card-layout__title")
    company: tuple[str, str] = ("a", "topcard__org-name-link")
    description: tuple[str, str] = ("div", "show-more-less-html__markup")


@dataclass(frozen=True)
class LinkSelector:
    """Links of one class inside containers of one class. A result list page."""

    container: tuple[str, str] = ("ul", "jobs-search__results-list")
    link_class: str = "base-card__full-link"


class _PageReader(HTMLParser):
    """Events of one page with the stack of open elements; text between tags comes in one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self._text: list[str] = []

    def read(self, html: str):
        self.feed(html)
        self.close()
        self._flush()
        return self

    def _flush(self) -> None:
        if self._text:
            self.on_text("".join(self._text))
            self._text = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        values = {k: v or "" for k, v in reversed(attrs)}
        self.on_element(tag, values)
        if tag not in _VOID:
            self.open.append((tag, values.get("class", "")))

    def handle_endtag(self, tag):
        self._flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break

    def handle_data(self, data):
        self._text.append(data)

    def handle_comment(self, data):
        self._flush()

    def on_element(self, tag: str, values: dict[str, str]) -> None:
        """An element starts."""

    def on_text(self, text: str) -> None:
        """A text node ends."""


class _Fields(_PageReader):
    def __init__(self, selectors: FieldSelectors) -> None:
        super().__init__()
        self.selectors = selectors
        self.title: str | None = None
        self.company: str | None = None
        self.pieces: list[str] = []

    @staticmethod
    def _fits(element: tuple[str, str], selector: tuple[str, str]) -> bool:
        return element[0] == selector[0] and selector[1] in element[1]

    def on_text(self, text: str) -> None:
        if not self.open:
            return
        if self.title is None and self._fits(self.open[-1], self.selectors.title):
            self.title = text
        if self.company is None and self._fits(self.open[-1], self.selectors.company):
            self.company = text
        if text.strip() and any(self._fits(e, self.selectors.description) for e in self.open):
            self.pieces.append(text.strip())


class _Links(_PageReader):
    def __init__(self, selector: LinkSelector) -> None:
        super().__init__()
        self.selector = selector
        self.links: list[str] = []

    def on_element(self, tag: str, values: dict[str, str]) -> None:
        name, classes = self.selector.container
        inside = any(t == name and (not classes or classes in c.split()) for t, c in self.open)
        wanted = self.selector.link_class
        if tag == "a" and inside and "href" in values and (
                not wanted or wanted in values.get("class", "").split()):
            link = values["href"].strip()
            if link:
                self.links.append(link)


def page_fields(pages: DataFrame, *, html: str = "html",
                selectors: FieldSelectors = FieldSelectors()) -> DataFrame:
    """Add job_title, company, job_description and ``error``.

    Title and company are the first text directly inside a matching element; the description is
    all text below matching ones, trimmed pieces joined by one blank. A page without a title or
    a description is an error for good: retrying it would not help.
    """

    @F.pandas_udf("job_title string, company string, job_description string")
    def fields(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body in batch:
                got = _Fields(selectors).read(body or "")
                rows.append(((got.title or "").strip(), (got.company or "").strip() or None,
                             " ".join(got.pieces)))
            yield pd.DataFrame(rows, columns=["job_title", "company", "job_description"])

    missing = (F.col("job_title") == "") | (F.col("job_description") == "")
    return (pages.withColumn("_fields", fields(html)).select("*", "_fields.*").drop("_fields")
            .withColumn("error", F.when(missing, "missing title or description")))


def page_links(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("url",),
               selector: LinkSelector = LinkSelector()) -> DataFrame:
    """One row per posting link of a result page, in page order (``place``)."""

    @F.pandas_udf("array<string>")
    def links(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_Links(selector).read(body or "").links for body in batch],
                            dtype=object)

    found = pages.select(*keep, links(html).alias("_links"))
    # Outer, then filtered: a plain posexplode would have the pages parsed twice.
    return found.select(*keep, F.posexplode_outer("_links").alias("place", "link")).filter(
        F.col("link").isNotNull())


def fetch_outcome(status: Column | str) -> Column:
    """What becomes of a fetched URL by HTTP status: 'ok', 'drop' (gone for good) or 'retry'."""
    status = F.col(status) if isinstance(status, str) else status
    return (F.when(status.isin(404, 410), "drop").when(status.between(200, 399), "ok")
            .otherwise("retry"))
