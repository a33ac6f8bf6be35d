"""Window packing as a table function, for SQL over prepared arrays."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register_windows(spark: SparkSession, name: str = "pack_windows") -> None:
    """``pack_windows(sizes, losses, query, room, overlap)``: windows of one segment.

    ``sizes`` and ``losses`` are arrays over the body's blocks, ``query`` is the
    0-based position of the segment's query block or null, ``room`` the window
    less the header.
    """
    from brindle.operators.packing import Block, Packer, Window

    @udtf(returnType="first int, end int, n_context int, has_query boolean, n_tokens int, n_loss int")
    class Windows:
        def eval(self, sizes: list, losses: list, query: int | None, room: int, overlap: int):  # noqa: ANN202
            packer = Packer(room, overlap)
            for k, (n, loss) in enumerate(zip(sizes, losses)):
                yield from self.rows(packer.push(Block(k, n, loss, k == query)))
            yield from self.rows(packer.close())

        def rows(self, got):  # noqa: ANN001, ANN202
            return [(w.first, w.end, len(w.shown), w.has_query, w.tokens, w.loss) for w in got if isinstance(w, Window)]

    spark.udtf.register(name, Windows)
