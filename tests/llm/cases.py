"""Small awkward tables that every operator must take."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside; as extra columns they must not disturb.
CLASHING = ["h", "f", "row", "code", "span", "score", "TEXT", "shard", "size", "taken_id", "kept"]

LINE = "This line stands in many documents and is long enough."
FRENCH = "le chat est dans la maison et la porte est fermée depuis hier soir"
ENGLISH = "the cat is in the house and the door has been closed since last night"


def documents() -> list[tuple]:
    rows = [
        (0, None, "en", "a", None),
        (1, "", None, None, 0),
        (2, "\n\n \t ", "en", "b", 5),
        (3, "12345 !!! ???", "fr", "a", 13),
        (None, f"{LINE}\nno id here", "en", None, None),
        (4, "x " * 30_000 + "\n" + LINE, "en", "hot", None),
        (5, ENGLISH, None, "a", None),
        (5, ENGLISH, None, "a", None),
        (6, "é" * 150 + " " + "é" * 150, "fr", "b", None),
    ]
    for k in range(10, 30):
        text = f"{ENGLISH if k % 2 else FRENCH} number {k} {k * 7919}\n  {LINE.upper()}\t\n{k}"
        rows.append((k, text, "en" if k % 2 else "fr", "hot", len(text)))
    return rows


def frame(spark, rows=None, extra: bool = True):
    """The table, by default with extra columns of clashing names."""
    docs = spark.createDataFrame(documents() if rows is None else rows, DOCS)
    if not extra:
        return docs
    widened = docs.selectExpr("*", *[f"cast(7 as int) as c{k}" for k in range(len(CLASHING))])
    return widened.toDF(*docs.columns, *CLASHING)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
