"""Model calls from Spark tasks: one client a partition, bounded calls in flight, order kept, retries with backoff."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import closing, contextmanager
from dataclasses import dataclass

import pandas as pd

ModelFn = Callable[[str, str], str]


class PermanentError(Exception):
    """A failure that another attempt cannot mend."""


@dataclass(frozen=True)
class CallPolicy:
    """``in_flight`` calls of a task run at a time (a job has at most that many times its running tasks); a call that
    raises is made again up to ``attempts`` times, after waits that start at ``wait`` seconds and double."""

    in_flight: int = 4
    attempts: int = 3
    wait: float = 0.25


class ClientPerPartition:
    """A model whose client (connection, session) is made by ``make()`` once for each partition and closed at its end,
    if it has a ``close``; the client is called as ``client(system, prompt)``, from several threads."""

    def __init__(self, make: Callable[[], ModelFn]):
        self.make = make


@contextmanager
def opened(model: ModelFn | ClientPerPartition) -> Iterator[ModelFn]:
    if not isinstance(model, ClientPerPartition):
        yield model
        return
    client = model.make()
    if hasattr(client, "close"):
        with closing(client):
            yield client
    else:
        yield client


def answer(client: ModelFn, system: str, prompt: str, policy: CallPolicy) -> str | None:
    """The model's answer; None if it fails at each attempt or for good."""
    for k in range(policy.attempts):
        try:
            return client(system, prompt)
        except PermanentError:
            return None
        except Exception:  # noqa: BLE001 - whatever a client raises is a failed call
            if k + 1 < policy.attempts:
                time.sleep(policy.wait * 2 ** k)
    return None


def answered(batches: Iterable[pd.DataFrame], model: ModelFn | ClientPerPartition, policy: CallPolicy,
             prompts: Callable[[pd.DataFrame], list[tuple[str, str]]], out: str) -> Iterator[pd.DataFrame]:
    """The batches with a column ``out`` of answers to ``prompts(batch)`` = [(system, prompt), ...], in row order."""
    with opened(model) as client, ThreadPoolExecutor(policy.in_flight) as pool:
        for pdf in batches:
            found = list(pool.map(lambda p: answer(client, *p, policy), prompts(pdf)))
            yield pdf.assign(**{out: pd.Series(found, index=pdf.index, dtype=object)})
