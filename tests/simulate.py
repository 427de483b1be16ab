"""Applies change rows one after another: the plain meaning of the fold."""


def run(changes, columns, soft=False, state=None):
    """``changes``: dicts with key, order, change_type and a dict of set values."""
    table = {k: dict(v) for k, v in (state or {}).items()}
    for change in sorted(changes, key=lambda c: c["replay_id"]):
        key, kind, values = change["key"], change["change_type"], change["values"]
        if kind == "CREATE" and key not in table:
            table[key] = {c: values.get(c) for c in columns}
            if soft:
                table[key]["is_deleted"] = None
        elif kind == "UPDATE" and key in table:
            table[key].update(values)
        elif kind == "DELETE" and key in table:
            if soft:
                table[key]["is_deleted"] = True
            else:
                del table[key]
        elif kind == "UNDELETE" and key in table and soft:
            table[key]["is_deleted"] = False
    return table
