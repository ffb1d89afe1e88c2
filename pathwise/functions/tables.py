"""Table functions for SQL: one text in, many rows out, in tasks, joined laterally.

    tables.register(spark)
    spark.sql("SELECT file, s.* FROM journals, LATERAL journal_sections(content) s")
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


@udtf(returnType="nth bigint, head string, date string, body string")
class JournalSections:
    """The sections under headings '## Entry ... date' of a journal, numbered from 1 in order, as `readers` has them."""

    def eval(self, content: str) -> Iterator[tuple]:
        nth, head, lines = 0, None, []
        for raw in (content or "").split("\n"):
            line = raw.rstrip("\r")
            if line.startswith("## Entry ") and DAY.search(line):
                if head is not None:
                    yield nth, head, DAY.search(head)[0], "\n".join(lines)
                nth, head, lines = nth + 1, line, []
            elif head is not None:
                lines.append(line)
        if head is not None:
            yield nth, head, DAY.search(head)[0], "\n".join(lines)


@udtf(returnType="line bigint, value string, n_words bigint")
class TextLines:
    """The lines of a text that say something, with their numbers from 1 and words between white space."""

    def eval(self, text: str) -> Iterator[tuple]:
        for number, value in enumerate((text or "").split("\n"), 1):
            words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", value) if w]
            if words:
                yield number, value, len(words)


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL as journal_sections and text_lines."""
    spark.udtf.register("journal_sections", JournalSections)
    spark.udtf.register("text_lines", TextLines)
