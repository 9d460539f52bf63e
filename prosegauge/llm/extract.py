"""Main text of web pages by a conditional random field over leaf blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from prosegauge.llm.blocks import Block, blocks
from prosegauge.llm.common import small_batches
from prosegauge.llm.crf import Chain
from prosegauge.llm.labelled_pages import AD, BODY, FOOT, FORM, HEAD, MENU, NOTICE, SHARE, SIDE, TALK, labelled

#: Labelled pages that the model is trained on.
PAGES = 500

ROLES = {part: role for role, pool in (("body", BODY), ("menu", MENU), ("ad", AD), ("side", SIDE), ("notice", NOTICE), ("foot", FOOT), ("head", HEAD), ("talk", TALK), ("form", FORM), ("share", SHARE)) for name in pool for part in name.split("-") if part not in ("main", "site", "box", "list", "body")}
ROLES |= {"main": "body", "adv": "ad", "sponsor": "ad", "footnote": "body", "sidebar": "side", "aside": "side", "navigation": "menu", "contentinfo": "foot", "complementary": "side", "cookies": "notice"}


def features(block: Block, at: int, n: int) -> list[str]:
    """Names of what holds for a block: the tags around it, their roles, its text."""
    text, tags = block.text, block.tags
    size, words = len(text), text.count(" ") + 1
    found = {f"in:{t}" for t in tags}
    roles = {ROLES[w] for w in block.words if w in ROLES}
    found |= {f"role:{r}" for r in roles} or {"role:none"}
    parent = block.parent
    linked = min(1.0, block.linked / max(1, size))
    link = "none" if not block.linked else "some" if linked < 0.5 else "most"
    length = sum(size >= x for x in (12, 30, 70, 150, 400))
    stop = text[-1] in ".!?…:;\"'”»)"
    unwanted = bool(roles - {"body"}) or not {"nav", "aside", "footer", "form", "header", "button"}.isdisjoint(tags)
    inside = "article" in tags or "main" in tags or "body" in roles
    found |= {"all", f"parent:{parent}", f"link:{link}", f"length:{length}", f"stop:{stop}", f"words:{min(words, 6)}"}
    found |= {f"unwanted:{unwanted}", f"inside:{inside}", f"both:{unwanted}:{inside}", f"parent:{parent}:{link}", f"length:{length}:{stop}:{link}", f"inside:{inside}:{length}"}
    found |= {f"first:{at == 0}", f"last:{at == n - 1}", f"sign:{'©' in text}"}
    return sorted(found)


class Model:
    """Feature names learnt in training and the field's weights; unseen names count for nothing."""

    def __init__(self, pages: int = PAGES):
        self.index: dict[str, int] = {}
        rows = []
        for html, parts in labelled(pages):
            made = blocks(html, ROLES)
            if len(made) != len(parts):
                raise AssertionError("a labelled page doesn't parse into its blocks")
            if made:
                named = [[self.index.setdefault(f, len(self.index)) for f in features(b, k, len(made))] for k, b in enumerate(made)]
                rows.append((named, [wanted for _, wanted in parts]))
        self.chain = Chain(len(self.index)).fit(rows)

    def wanted(self, page: list[Block]) -> list[int]:
        if not page:
            return []
        at = self.index
        rows = [[at[f] for f in features(b, k, len(page)) if f in at] for k, b in enumerate(page)]
        return self.chain.decode(self.chain.scores(rows))

    def text(self, html: str | None) -> str:
        page = blocks(html, ROLES)
        return "\n\n".join(b.text for b, keep in zip(page, self.wanted(page), strict=True) if keep)


@cache
def trained(pages: int = PAGES) -> Model:
    """The same for the same number of pages: their making and the training are seeded."""
    return Model(pages)


def main_text(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points); columns of those names are replaced.

    A null or empty page, and one without a wanted block, has an empty text. Pages
    of any length are read whole. Repeated rows are kept; an empty table stays so.
    """
    model = model or trained()
    small_batches(pages.sparkSession)
    kept = pages.select(F.col(html).alias("_html"), *[c for c in pages.columns if c not in ("text", "n_chars")])
    out = StructType(kept.schema.fields[1:]).add("text", StringType()).add("n_chars", LongType())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [model.text(h) for h in batch.column(0).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), sizes], names=[*batch.schema.names[1:], "text", "n_chars"])

    return kept.mapInArrow(run, out)
