"""Packing token blocks into training windows.

The plan of the windows needs only lengths: blocks stream through in order and
the packer holds the open window and the few blocks that may become context.
Tokens and labels are then put together by the engine, block by block.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from brindle.plans.folds import fold_by_key
from brindle.plans.materialize import materialize

#: Share of the window that a header may take at most.
HEADER_SHARE = 0.9
#: The label of tokens that are shown but not learned.
IGNORE = -100

_PLAN = StructType(
    [StructField(n, t) for n, t in (
        ("episode", StringType()), ("thread", StringType()), ("kind", StringType()), ("segment", LongType()), ("window_no", LongType()), ("first_block", LongType()), ("end_block", LongType()),
        ("ctx_blocks", ArrayType(LongType())), ("loss_blocks", ArrayType(LongType())), ("has_query", BooleanType()), ("header_tokens", LongType()), ("n_tokens", LongType()), ("n_loss_tokens", LongType()),
    )]
)


class Block(NamedTuple):
    no: int
    size: int
    loss: int
    query: bool


@dataclass
class Window:
    """An open window: what is shown before, and the blocks up to the last one with loss."""

    shown: list[int]
    has_query: bool
    used: int  # tokens shown before and taken so far
    first: int
    end: int = 0
    tokens: int = 0  # up to the last block with loss
    loss: int = 0
    loss_blocks: list[int] = field(default_factory=list)

    def take(self, b: Block) -> None:
        self.used += b.size
        if b.loss:
            self.end, self.tokens = b.no + 1, self.used
            self.loss += b.loss
            self.loss_blocks.append(b.no)


class Packer:
    """Windows of a thread's body, given its blocks in order: ``room`` tokens each, after ``overlap`` tokens of context at most."""

    def __init__(self, room: int, overlap: int) -> None:
        self.room, self.overlap = room, overlap
        self.recent: deque[Block] = deque()  # the longest run just passed that fits the overlap
        self.held = 0
        self.query: Block | None = None
        self.open: Window | None = None

    def push(self, b: Block) -> Iterator[Window | Block]:
        """The window that ``b`` closes, if any, or ``b`` itself where no window can hold its loss."""
        if self.open and self.open.used + b.size > self.room:
            yield self.open
            self.open = None
        if not self.open and b.loss:
            if b.size > self.room:
                yield b
            else:
                self.open = self._start(b)
        if self.open:
            self.open.take(b)
        self.recent.append(b)
        self.held += b.size
        while self.held > self.overlap:
            self.held -= self.recent.popleft().size
        if b.query and self.query is None:
            self.query = b

    def close(self) -> Iterator[Window]:
        """End the segment: its window and its query are done, while its last blocks stay context for the next."""
        if self.open:
            yield self.open
        self.open, self.query = None, None

    def _start(self, b: Block) -> Window:
        shown = [x.no for x in self.recent]
        used = self.held
        if self.query and self.query.no not in shown:
            shown.insert(0, self.query.no)
            used += self.query.size
        if used + b.size <= self.room:
            return Window(shown, self.query is not None, used, b.no)
        if self.query and self.query.size + b.size <= self.room:
            return Window([self.query.no], True, self.query.size, b.no)
        return Window([], False, 0, b.no)


def _usable(blocks: DataFrame) -> DataFrame:
    """Blocks with a place in a thread, each once; a mask of another length than ids counts as none, null ids as no tokens."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    fits = F.coalesce(F.size("mask") == F.size(ids), F.lit(False))
    return blocks.where("block_id is not null and episode is not null and thread is not null and segment is not null and block_no is not null").select(
        "block_id", "episode", "thread", F.col("segment").cast("long").alias("segment"), F.col("block_no").cast("long").alias("block_no"),
        F.coalesce("is_query", F.lit(False)).alias("is_query"), ids.alias("ids"), F.when(fits, F.col("mask")).alias("mask"),
    )


def block_sizes(blocks: DataFrame) -> DataFrame:
    """(episode, thread, segment, block_no, is_query, n, loss): lengths only, each block once; arrays stay in the scan."""
    loss = F.coalesce(F.aggregate("mask", F.lit(0), lambda a, m: a + F.coalesce(m, F.lit(0))), F.lit(0))
    sizes = _usable(blocks).select("block_id", "episode", "thread", "segment", "block_no", "is_query", F.size("ids").cast("long").alias("n"), loss.cast("long").alias("loss"))
    return sizes.dropDuplicates(["block_id"]).drop("block_id")


def plan_windows(blocks: DataFrame, window: int, overlap: int) -> DataFrame:
    """The plan: rows of kind ``window``, ``skipped`` (a block with loss that no window can hold) and ``error`` (a thread without header, or with one above nine tenths of the window).

    Every block with loss of every segment is in one window or skipped. A window
    starts at the next such block of its segment: header (blocks 0 and 1), then
    the longest run of blocks right before it that fits ``overlap``, then blocks
    up to the last one with loss that fits. The segment's own query block is
    always shown if it lies before; where the first block does not fit behind
    its context, the context shrinks to the query block or to nothing.
    A skipped block has its tokens in n_tokens, an error the header's.
    """

    def fold(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        header, heads, segment, number, packer = 0, 0, None, 0, None

        def row(kind: str, *rest: object) -> tuple:
            return *key, kind, *rest

        def out(got: Iterator[Window | Block]) -> Iterator[tuple]:
            nonlocal number
            for x in got:
                if isinstance(x, Block):
                    yield row("skipped", segment, None, x.no, x.no + 1, [], [x.no], False, header, x.size, x.loss)
                else:
                    number += 1
                    yield row("window", segment, number, x.first, x.end, x.shown, x.loss_blocks, x.has_query, header, header + x.tokens, x.loss)

        for _, _, seg, no, query, n, loss in rows:
            if no < 2:
                header += n
                heads += 1
                continue
            if packer is None:
                if heads != 2 or header > HEADER_SHARE * window:
                    break
                packer = Packer(window - header, overlap)
            if segment is not None and seg != segment:
                yield from out(packer.close())
                number = 0
            segment = seg
            yield from out(packer.push(Block(no, n, loss, query)))
        if packer is not None:
            yield from out(packer.close())
        elif heads != 2 or header > HEADER_SHARE * window:
            yield row("error", None, None, None, None, [], [], False, header, header, 0)

    return fold_by_key(block_sizes(blocks), ["episode", "thread"], ["block_no"], fold, _PLAN)


def pack_windows(blocks: DataFrame, window: int, overlap: int) -> DataFrame:
    """(episode, thread, segment, window_no, first_block, end_block, n_context, has_query, n_tokens, n_loss_tokens) of the planned windows."""
    return plan_windows(blocks, window, overlap).where("kind = 'window'").select(
        "episode", "thread", "segment", "window_no", "first_block", "end_block", F.size("ctx_blocks").cast("long").alias("n_context"), "has_query", "n_tokens", "n_loss_tokens"
    )


def render_windows(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """(episode, thread, segment, window_no, input_ids, labels, first_block, end_block, ctx_blocks, loss_blocks, header_tokens, n_tokens, n_loss_tokens) of the planned windows.

    Labels are the ids where the mask of a window's own block is set, else
    ``IGNORE``. A window's parts meet by its key, so what is collected is
    bounded by the window's size.
    """
    key = ["episode", "thread", "segment", "window_no"]
    part = lambda no, learned: F.struct(no.alias("block_no"), F.lit(learned).alias("learned"))
    shown = F.concat(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")), F.col("ctx_blocks"))
    own = F.sequence(F.col("first_block"), F.col("end_block") - 1)
    windows = plan.where("kind = 'window'")
    parts = windows.select(*key, F.posexplode(F.concat(F.transform(shown, lambda x: part(x, False)), F.transform(own, lambda x: part(x, True)))).alias("pos", "p")).select(*key, "pos", "p.*")
    label = lambda i, m: F.when(F.col("learned") & (m != 0), i).otherwise(F.lit(IGNORE))
    tokens = _usable(blocks).dropDuplicates(["block_id"]).select("episode", "thread", "block_no", "ids", F.coalesce("mask", F.transform("ids", lambda _: F.lit(0))).alias("mask"))
    labelled = parts.join(tokens.hint("merge"), ["episode", "thread", "block_no"]).select(*key, F.struct("pos", "ids", F.zip_with("ids", "mask", label).alias("labels")).alias("part"))
    whole = labelled.groupBy(*key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    flat = lambda name: F.flatten(F.transform("parts", lambda x: x[name]))
    got = whole.select(*key, flat("ids").alias("input_ids"), flat("labels").alias("labels"))
    return got.join(windows.select(*key, "first_block", "end_block", "ctx_blocks", "loss_blocks", "header_tokens", "n_tokens", "n_loss_tokens").hint("merge"), key)


def render_statistics(plan: DataFrame) -> DataFrame:
    """(episode, threads, windows, total_tokens, loss_tokens, skipped_blocks, errors) by episode, and the totals with a null episode."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    total = lambda c: F.coalesce(F.sum(F.when(F.col("kind") == "window", F.col(c))), F.lit(0))
    return plan.withColumn("name", F.struct("episode", "thread")).groupingSets([["episode"], []], "episode").agg(
        F.countDistinct("name").alias("threads"), count("window").alias("windows"), total("n_tokens").alias("total_tokens"), total("n_loss_tokens").alias("loss_tokens"),
        count("skipped").alias("skipped_blocks"), count("error").alias("errors"),
    )


def rendered(blocks: DataFrame, window: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The windows with tokens and labels, and the statistics; the plan is written once for both."""
    plan = materialize(plan_windows(blocks, window, overlap), "windows")
    return render_windows(blocks, plan), render_statistics(plan)
