"""Name to SQL, for every query that SQL can state."""

from oracles import bars_sql, data_sql, events_sql


def all_statements() -> dict[str, str]:
    return {**bars_sql.oracles(), **events_sql.oracles(), **data_sql.oracles()}
