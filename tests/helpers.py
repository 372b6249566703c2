"""Small tables in the contract types."""

from werkbank.sources.schemas import ERP, conform


def table(spark, schema, rows):
    """A table from dicts; values are given as text or plain Python values."""
    names = sorted({n for r in rows for n in r}) or [schema.fields[0].name]
    text = [tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows]
    raw = spark.createDataFrame(text, ", ".join(f"`{n}` string" for n in names))
    return conform(raw, schema)


def erp(spark, **rows):
    return {name: table(spark, schema, rows.get(name, [])) for name, schema in ERP.items()}


def values(df, *columns, sort=False):
    out = [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]
    return sorted(out, key=repr) if sort else out
