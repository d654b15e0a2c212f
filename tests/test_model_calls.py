"""Model calls: bounded concurrency, one client a partition, order, retries and permanent failures."""

import threading
import time

import pandas as pd

from sifter.config import DigestConfig
from sifter.functions import constants as K
from sifter.operators import extract as X
from sifter.operators import triage as TR
from sifter.operators.model_calls import CallPolicy, ClientPerPartition, PermanentError, answer, answered


class SlowClient:
    """Answers after a while; tells how many calls it had open at most and how many clients were made."""

    made = closed = 0

    def __init__(self):
        SlowClient.made += 1
        self.lock, self.open, self.most = threading.Lock(), 0, 0

    def __call__(self, system, prompt):
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
        time.sleep(0.02 + 0.03 * (hash(prompt) % 3))            # answers come back out of order
        with self.lock:
            self.open -= 1
        return f"{system}:{prompt}"

    def close(self):
        SlowClient.closed += 1


def frames(n, size):
    return [pd.DataFrame({"p": [f"q{i}" for i in range(a, min(a + size, n))]}, index=range(100, 100 + min(size, n - a))) for a in range(0, n, size)]


def asked(pdf):
    return [("s", x) for x in pdf["p"]]


def test_calls_in_flight_and_order():
    clients = []

    def make():
        clients.append(SlowClient())
        return clients[-1]

    took = {}
    for width in (1, 8):
        start = time.monotonic()
        out = pd.concat(list(answered(frames(48, 16), ClientPerPartition(make), CallPolicy(in_flight=width), asked, "r")))
        took[width] = time.monotonic() - start
        assert list(out["r"]) == [f"s:q{i}" for i in range(48)]
    assert [c.most for c in clients] == [1, 8] and SlowClient.made == SlowClient.closed == 2
    assert took[8] < took[1] / 3


def test_retries_and_permanent_failures():
    calls = []

    def flaky(system, prompt):
        calls.append((prompt, time.monotonic()))
        n = sum(p == prompt for p, _ in calls)
        if prompt == "never" or (prompt == "third" and n < 3):
            raise RuntimeError("busy")
        if prompt == "bad":
            raise PermanentError("no such model")
        return "ok"

    policy = CallPolicy(attempts=3, wait=0.05)
    assert [answer(flaky, "s", p, policy) for p in ("first", "third", "never", "bad")] == ["ok", "ok", None, None]
    tries = {p: [t for q, t in calls if q == p] for p in ("first", "third", "never", "bad")}
    assert {p: len(t) for p, t in tries.items()} == {"first": 1, "third": 3, "never": 3, "bad": 1}
    a, b, c = tries["third"]
    assert b - a >= 0.05 and c - b >= 0.1                        # the wait doubles


def test_in_spark_a_client_is_made_for_each_partition(spark):
    """Same answers whatever the width; failures become the reference's defaults."""
    def make():
        seen = []

        def client(system, prompt):
            seen.append(prompt)
            if prompt.endswith("7"):
                raise PermanentError("no")
            return f"{prompt}!"
        return client

    packed = spark.createDataFrame([(i, 1, "s", f"p{i}") for i in range(200)], "batch_id long, n_emails long, system string, prompt string")
    expect = {i: None if i % 10 == 7 else f"p{i}!" for i in range(200)}
    for width in (1, 6):
        rows = TR.score_batches(packed, ClientPerPartition(make), 3, CallPolicy(in_flight=width)).collect()
        assert {r.batch_id: r.response for r in rows} == expect
    windows = spark.createDataFrame([("a", i, f"chunk {i}") for i in range(10)], "id string, chunk_no int, chunk_text string")

    def summary(system, prompt):
        if prompt.endswith("3"):
            raise PermanentError("no")
        return prompt[-1]

    got = {r.chunk_no: r.summary for r in X.summarize_windows(windows, summary).collect()}
    # the template ends with the chunk, so the answer is its number; a failure gives the start of the chunk
    assert got == {i: "chunk 3..." if i == 3 else str(i) for i in range(10)} and K.CHUNK_SUMMARY_USER.endswith("{chunk}")
    assert DigestConfig().token_budget == 4000
