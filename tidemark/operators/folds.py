"""Folds over rows in order: a key's state goes from batch to batch, so a key of any length takes the memory of one batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[tuple], tuple]


def _sorted(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def extended(df: DataFrame, keys: list[str], order: list[str], make: Callable[[], Step], extra: str) -> DataFrame:
    """df with more columns, ``extra`` being their schema: make() gives a key's step, which takes row after row (a named
    tuple) and returns their values."""
    names = [part.split()[0] for part in extra.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != at:
                    at, step = key, make()
                out.append(step(row))
            columns = list(zip(*out)) or [()] * len(names)
            yield pdf.assign(**{n: pd.Series(list(c), index=pdf.index, dtype=object) for n, c in zip(names, columns)})

    return _sorted(df, keys, order).mapInPandas(run, f"{_ddl(df)}, {extra}")


class Ledger:
    """A key's state in emitted(): take() gets row after row, end() comes after the last; both give rows to hand on."""

    def take(self, row: tuple) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def emitted(df: DataFrame, keys: list[str], order: list[str], make: Callable[[tuple], Ledger], schema: str) -> DataFrame:
    """(keys, what the ledgers hand on): make(first row of the key) gives its ledger; ``schema`` names what it hands on."""
    kinds = dict(df.dtypes)
    names = [*keys, *[part.split()[0] for part in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ledger, out = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != at:
                    if ledger is not None:
                        out += [(*at, *x) for x in ledger.end()]
                    at, ledger = key, make(row)
                out += [(*key, *x) for x in ledger.take(row)]
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
                out = []
        if ledger is not None and (last := [(*at, *x) for x in ledger.end()]):
            yield pd.DataFrame(last, columns=names, dtype=object)

    return _sorted(df, keys, order).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {schema}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
