"""Put check SQL together from fixture views and extra steps."""

from __future__ import annotations

from drawlog.plans.fixtures import check_views

_NEEDS = {"rec_batches": ["rec_log"], "path_refs": ["rec_log"]}


def check_sql(select: str, views: list[str] = (), steps: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    texts = check_views()
    names: list[str] = []
    for v in views:
        for need in [*_NEEDS.get(v, []), v]:
            if need not in names:
                names.append(need)
    parts = [(n, texts[n]) for n in names] + list(steps)
    if not parts:
        return select
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({sql.strip()})" for n, sql in parts) + "\n" + select.strip()
