"""Labelling texts by a table of keyword rules: all keywords are found in one pass over a text.

A rule is one or more rows (rule, priority, keyword, then, within): the text has the
keyword, ASCII case ignored; where ``then`` is given, that must begin at most
``within`` characters behind the keyword's end, on the same line.  The keywords of all
rules form one automaton, built once in each worker, so a text is read once however many
rules there are, and the first rule (least priority) is chosen in the row: nothing is
shuffled.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

RULES_SCHEMA = "rule string, priority int, keyword string, then string, within int"
#: Rows of a rule table: it is sent to every worker.
MAX_ROWS = 100_000
LINE_ENDS = "\n\r\x85  "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rules:
    """The automaton of a rule table (rule, priority, keyword, then, within)."""

    def __init__(self, rows: list[tuple]):
        import ahocorasick

        self.rows = sorted(((p, r, k.lower(), t.lower() if t else None, w) for r, p, k, t, w in rows if k), key=lambda x: (x[0], x[1], x[2]))
        self.automaton = ahocorasick.Automaton()
        of: dict[str, list[int]] = {}
        for i, (_, _, k, t, _) in enumerate(self.rows):
            of.setdefault(k, []).append(i)
            if t:
                of.setdefault(t, [])
        for word, own in of.items():
            self.automaton.add_word(word, (word, own))
        if of:
            self.automaton.make_automaton()
        self.seconds = {t for _, _, _, t, _ in self.rows if t}

    def matches(self, text: str) -> list[int]:
        """Rows that the text (in lower case) has, in order of priority."""
        if not self.rows or not text:
            return []
        plain, ends, starts = set(), {}, {}
        for at, (word, own) in self.automaton.iter(text):
            if word in self.seconds:
                starts.setdefault(word, []).append(at - len(word) + 1)
            for i in own:
                if self.rows[i][3] is None:
                    plain.add(i)
                else:
                    ends.setdefault(i, []).append(at + 1)
        for i, places in ends.items():
            *_, then, within = self.rows[i]
            if self._follows(text, places, sorted(starts.get(then, [])), within or 0):
                plain.add(i)
        return sorted(plain)

    @staticmethod
    def _follows(text: str, ends: list[int], starts: list[int], within: int) -> bool:
        for e in ends:
            k = bisect.bisect_left(starts, e)
            # the nearest is enough: one farther off has the same characters in between, and more
            if k < len(starts) and starts[k] - e <= within and not any(c in LINE_ENDS for c in text[e:starts[k]]):
                return True
        return False


def first_rules(texts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of ``texts`` (with a column ``text``), the first matching rule (null if none) and how many rules match.

    A null or empty text matches nothing; rules of equal priority are taken by name."""
    rows = [tuple(r) for r in rules.select("rule", "priority", "keyword", "then", "within").limit(MAX_ROWS + 1).collect()]
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a rule table has at most {MAX_ROWS} rows")
    table = texts.sparkSession.sparkContext.broadcast(rows)
    low = texts.select(*keys, F.translate("text", UPPER, LOWER).alias("text"))
    schema = low.drop("text").schema.add("rule", StringType()).add("n_rules", IntegerType())

    def label(batches):
        own = Rules(table.value)
        for b in batches:
            found = [own.matches(t) for t in b.column(b.num_columns - 1).to_pylist()]
            names = [own.rows[m[0]][1] if m else None for m in found]
            counts = [len({own.rows[i][1] for i in m}) for m in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(counts, pa.int32())],
                                             [*keys, "rule", "n_rules"])

    return low.mapInArrow(label, schema)
