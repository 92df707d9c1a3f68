"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each text starts with the WITH clause of the adapter views it reads (the same
view definitions the Spark side uses) and then states the result from its written
rules; it shares no plan, term list or helper with the Spark operators.
"""


def all_sql() -> dict[str, str]:
    from sqlcheck import collections, features, ingest, retry_cost
    out: dict[str, str] = {}
    for mod in (collections, retry_cost, features, ingest):
        out.update(mod.SQL)
    return out
