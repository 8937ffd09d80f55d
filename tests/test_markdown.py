"""Markdown blocks, sections and front matter."""

import random
import time

from quern.operators import markdown

TEXT = """---
title: "A page"
tags: [x, 'y z']
groups:
  - staff
  - ops
odd line
---
# One
Intro line
goes on.

```python
# no heading
| a | b |
```
## Two ##
| a | b |
|---|---|
| 1 | 2 |

- item
  more

  still
- next
Setext
======
> quote
lazy
***
~~~
open"""


def test_blocks_and_sections():
    told, start = markdown.front_matter(TEXT)
    assert told == {"title": ["A page"], "tags": ["x", "y z"], "groups": ["staff", "ops"]} and TEXT[start:].startswith("# One")
    found = markdown.blocks(TEXT, start)
    assert [(k, n, t) for k, n, t, *_ in found] == [
        ("heading", 1, "One"), ("paragraph", 0, ""), ("code", 0, ""), ("heading", 2, "Two"), ("table", 0, ""), ("list", 0, ""), ("quote", 0, ""), ("rule", 0, ""), ("code", 0, ""),
    ]
    assert TEXT[found[2][3] : found[2][4]] == "```python\n# no heading\n| a | b |\n```"
    assert TEXT[found[4][3] : found[4][4]] == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert TEXT[found[-1][3] : found[-1][4]] == "~~~\nopen"


def test_setext_and_ends_of_sections():
    text = "# A\na\n## B\nb\n### C\nc\n## D\nd\nTop\n===\ne"
    found = markdown.blocks(text)
    told = markdown.sections(found, len(text))
    heads = {t: (n, text[s:end]) for (k, n, t, s, _), (end, _) in zip(found, told) if k == "heading"}
    assert heads["C"] == (3, "### C\nc\n") and heads["B"] == (2, "## B\nb\n### C\nc\n") and heads["d Top"][0] == 1 and heads["d Top"][1].endswith("e")
    assert told[5][1] == ["A", "B", "C"] and told[-1][1] == ["d Top"]


def test_sections_end_at_the_nearest_heading_of_no_lower_rank():
    r = random.Random(6)
    for _ in range(100):
        text = "\n".join("#" * r.randint(1, 5) + f" h{i}\nx" for i in range(r.randint(0, 25)))
        found = markdown.blocks(text)
        for i, ((kind, level, _, start, _), (end, path)) in enumerate(zip(found, markdown.sections(found, len(text)))):
            if kind == "heading":
                later = [b[3] for b in found[i + 1 :] if b[0] == "heading" and b[1] <= level]
                above, least = [], level
                for b in reversed(found[:i]):
                    if b[0] == "heading" and b[1] < least:
                        above.insert(0, b[2])
                        least = b[1]
                assert end == (later[0] if later else len(text)) and path == above


def test_spans_hold_all_that_is_not_blank():
    r = random.Random(7)
    parts = ["# h", "text", "", "```", "~~~~", "- a", "  b", "> q", "| a |", "|---|", "---", "===", "\t", "1. x", "é漢"]
    for _ in range(300):
        text = r.choice(["\n", "\r\n"]).join(r.choice(parts) for _ in range(r.randint(0, 25)))
        found = markdown.blocks(text)
        assert all(a[4] <= b[3] for a, b in zip(found, found[1:])) and all(s < e for *_, s, e in found)
        inside = "".join(text[s:e] for *_, s, e in found)
        assert "".join(inside.split()) == "".join(text.split())
    assert markdown.front_matter("---\na: 1\nno end") == ({}, 0) and markdown.blocks("") == [] and markdown.front_matter("") == ({}, 0)


def test_long_texts():
    for part in ("#", "# h\n", "|-", "- a\n", "`", "```\n", "> ", "\n", "* ", "-- ", "a\n---\n"):
        began = time.process_time()
        text = part * (1_000_000 // len(part))
        markdown.sections(markdown.blocks(text, markdown.front_matter(text)[1]), len(text))
        assert time.process_time() - began < 20, part


def test_rows(spark):
    df = spark.createDataFrame([(1, TEXT, "x"), (2, None, "y"), (3, " \n", "z")], "id long, text string, Kind string")
    found = markdown.outline(df).orderBy("id", "position").collect()
    assert found[0].title == "One" and found[0].section_end > found[0].char_end and {r.id for r in found} == {1}
    assert all(TEXT[r.char_start : r.char_end] == r.chunk for r in found)
    told = {r.id: r.settings for r in markdown.settings(df).collect()}
    assert told[1]["groups"] == ["staff", "ops"] and told[2] == told[3] == {}


def test_texts_are_read_once(spark):
    rows = markdown.outline(spark.range(3).selectExpr("id", "'# A' AS text"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("read(") == 1 and rows.count() == 3
