"""Named components: registering a name twice or asking for an unknown one is a KeyError."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self, kind: str):
        self.kind, self._made = kind, {}

    def register(self, name: str) -> Callable:
        if name in self._made:
            raise KeyError(f"{self.kind} {name} is registered already")

        def add(f):
            self._made[name] = f
            return f

        return add

    def create(self, name: str, **options):
        if name not in self._made:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self._made))}")
        return self._made[name](**options)

    def names(self) -> list[str]:
        return sorted(self._made)


DECODERS = Registry("decoder")


@DECODERS.register("prefix_beam")
def _beam(width: int, **options):
    from .functions.decode import beam_udf

    return beam_udf(width, **options)


@DECODERS.register("greedy")
def _greedy(width: int, letters: str = "ACGT"):
    from pyspark.sql import functions as F

    from .functions import sequence as sq

    return lambda c: sq.greedy_ctc(F.transform(sq.rows_of(F.col(c) if isinstance(c, str) else c, width), sq.argmax), letters)


@DECODERS.register("enter_extend")
def _enter_extend():
    from .functions.decode import enter_extend_udf

    return enter_extend_udf()


@DECODERS.register("blank_path")
def _blank_path(width: int, **options):
    from .functions.decode import blank_viterbi_udf

    return blank_viterbi_udf(width, **options)
