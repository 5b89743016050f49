"""Main text of web pages by the paths that the pages of a host agree on.

Three steps, two passes over the pages:

1. Each page scores its containers: the characters of the blocks below them, links counted against
   them, more for article and main elements and names like "content". From the top of the page down,
   the container that holds most of its parent's score is taken while there is one; the last one is
   the page's choice. Menus, footers and other furniture do not count.
2. The choices are votes: Spark counts them by host and generalised tag-class path. A path wins if
   it has at least ``SHARE`` of the votes of its host, so a host has at most 1 / SHARE winners.
3. Each page is read again; its text are the blocks below the elements on the winning path with the
   most votes that the page has, or those of its own choice if it has none of them. So a page whose
   article is shorter than its adverts is read as the other pages of its host are.

What is shuffled: votes, summed in each task before; the winners are joined with the pages by host,
broadcast if they are few bytes, else dealt with the pages of a hot host to many tasks. Pages
themselves are shuffled only in that last case. A task holds one batch of pages.

Defined cases: a null or empty page has an empty text; a null or unreadable url belongs to a host
of its own name ""; repeated rows and null ids are pages of their own; of paths with equal votes
the smaller name counts first; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.session import pin

from .html_blocks import HARD, PIECES, PLAIN, Page, read
from .lookup import look_up

# share of a host's votes that makes a path a winner
SHARE = 0.05
# share of its parent's score that a container must hold to be gone into
MOST = 0.75
# weights of elements that say what they are, and of characters in links
CORE, NAMED, LINK = 3.0, 1.5, 2.0


def choose(page: Page) -> int | None:
    """The element that holds the text of a page, as far as the page alone can tell."""
    count = len(page.tags)
    score = [0.0] * count
    for element, text, link in page.blocks:
        score[element] += max(len(text) - LINK * link, 0.0)
    for i in range(count - 1, 0, -1):
        if page.tags[i] in ("article", "main"):
            score[i] *= CORE
        elif page.good[i]:
            score[i] *= NAMED
        score[page.parents[i]] += score[i]
    if score[0] <= 0:
        return None
    best: dict[int, int] = {}
    for i in range(1, count):
        if page.kinds[i] == PLAIN and page.tags[i] not in PIECES and score[i] > 0:
            above = page.parents[i]
            if above not in best or score[i] > score[best[above]]:
                best[above] = i
    at = 0
    while at in best and score[best[at]] >= MOST * score[at] * (
        1 / CORE if page.tags[at] in ("article", "main") else 1 / NAMED if page.good[at] else 1
    ):
        at = best[at]
    return at


def text_below(page: Page, number: int) -> str:
    """The blocks below the elements of a path, one a line."""
    below = [False] * len(page.tags)
    for i in range(len(below)):
        on = page.paths[i] == number and page.kinds[i] != HARD
        below[i] = on or (i > 0 and below[page.parents[i]])
    return "\n".join(text for element, text, _ in page.blocks if below[element])


def extract(html: str, winners: Sequence[str] = ()) -> str:
    """The main text of a page: that of the first winning path it has, or its own choice."""
    page = read(html)
    for name in winners:
        number = page.path_number(name)
        if number is not None:
            text = text_below(page, number)
            if text:
                return text
    own = choose(page)
    return "" if own is None else text_below(page, page.paths[own])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter[tuple[str, str]] = Counter()
        for host, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html"))):
            if html:
                page = read(html)
                own = choose(page)
                if own is not None:
                    votes[host, page.path_name(page.paths[own])] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([host for host, _ in votes], pa.string()),
                pa.array([path for _, path in votes], pa.string()),
                pa.array(list(votes.values()), pa.int64()),
            ],
            names=["host", "path", "n"],
        )


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths) from pages (host, html): winning paths, most votes first."""
    votes = pin(
        pages.mapInArrow(_votes, "host string, path string, n long")
        .groupBy("host", "path")
        .agg(F.sum("n").alias("n"))
    )
    of_host = votes.groupBy("host").agg(F.sum("n").alias("all"))
    size = F.octet_length("host") + 16
    return (
        look_up(votes, of_host, "host", size, F.col("path"))
        .where(F.col("n") >= SHARE * F.col("all"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("won"))
        .select("host", F.col("won.path").alias("paths"))
    )


def main_texts(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    pages = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    ).withColumn("host", _host(F.col("url")))
    kind = pages.schema["id"].dataType.simpleString()
    winners = pin(winning_paths(pages.select("host", "html")))
    size = F.octet_length("host") + F.aggregate(
        "paths", F.lit(16), lambda total, path: total + F.octet_length(path) + 16
    )
    found = look_up(pages, winners, "host", size, F.col("url"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist())
            own = [extract(html or "", paths or ()) for html, paths in pairs]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("url"),
                    pa.array(own, pa.string()),
                    pa.array([len(t) for t in own], pa.int64()),
                ],
                names=["id", "url", "text", "n_chars"],
            )

    return found.select("id", "url", "html", "paths").mapInArrow(
        texts, f"id {kind}, url string, text string, n_chars long"
    )
