"""Out-links of fetched HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonicalize
from ..schema import CanonPolicy
from ..storage import bounded_batches

STEP = 128  # pages that are taken apart at a time
LINK = {"page_id": pa.int64(), "position": pa.int64(), "target": pa.string(), "depth": pa.int32()}
_UNSEEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_ANCHOR = r"""(?is)<a(?:rea)?\s(?:[^>]*?\s)??href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def hrefs(html: Column) -> Column:
    """Targets of ``a`` and ``area``, in order, as column expressions: quoted in either way or bare, whatever attributes
    stand before, outside comments, scripts and styles; empty targets are none, a null page has none.

    Of character references only ``&amp;`` is resolved, and a ``>`` in an attribute before the target ends the tag;
    ``extract_links`` has the full tokenizer."""
    found = F.regexp_extract_all(F.regexp_replace(html, _UNSEEN, ""), F.lit(_ANCHOR), F.lit(0))
    target = lambda m: F.concat(*[F.regexp_extract(m, _ANCHOR, k) for k in (1, 2, 3)])  # noqa: E731  one of the three is not empty
    return F.filter(F.transform(found, lambda m: F.replace(target(m), F.lit("&amp;"), F.lit("&"))), lambda t: t != "")


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("a", "area"):
            self.found += [v for k, v in attrs if k == "href" and v][:1]


def anchor_targets(html: str | None) -> list[str]:
    parser = _Anchors()
    parser.feed(html or "")
    parser.close()
    return parser.found


def links_in(batches: Iterator[pa.RecordBatch], policy: CanonPolicy = CanonPolicy()) -> Iterator[pa.RecordBatch]:
    """The links of (page_id, url, html, depth) as one small batch for every ``STEP`` pages."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            found: list[tuple] = []
            for page, url, html, level in zip(*(c.to_pylist() for c in batch.slice(at, STEP).columns), strict=True):
                targets = (canonicalize(raw, url, policy) for raw in anchor_targets(html))
                found += [(page, k, t, min(65535, int(level) + 1)) for k, t in enumerate(dict.fromkeys(t for t in targets if t))]
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, LINK.values(), strict=True)], names=list(LINK))


def extract_links(pages: DataFrame, depth: str | None = None, policy: CanonPolicy = CanonPolicy()) -> DataFrame:
    """(page_id, position, target, depth) of every distinct link of a page, resolved and canonical, with a full
    HTML tokenizer; depth is one more than the page's, up to 65535. A task holds one bounded batch of pages and the
    links of ``STEP`` of them, however many pages there are."""

    bounded_batches(pages)
    level = F.lit(0) if depth is None else F.col(depth)
    return pages.select("page_id", "url", "html", level.alias("level")).mapInArrow(lambda batches: links_in(batches, policy), "page_id long, position long, target string, depth int")
