"""Plain helpers that Arrow functions import on workers."""

from __future__ import annotations

import io
import json
import pickle


def break_line(s: str, width: int) -> list[str]:
    """Parts of at most width characters, cut behind the last of , ; : ? before it, else the last space, else hard."""
    out = []
    while len(s) > width:
        at = max(s.rfind(c, 0, width) for c in ",;:?")
        space = s.rfind(" ", 0, width)
        at = at + 1 if at > 0 else (space if space > 0 else width)
        out.append(s[:at].strip())
        s = s[at:].strip()
    return [*out, s] if s else out


def repeated_keys(text: str) -> list[str]:
    seen, twice = set(), set()

    def pairs(items):
        for k, _ in items:
            (twice if k in seen else seen).add(k)
        return dict(items)

    json.loads(text, object_pairs_hook=pairs)
    return sorted(twice)


class PlainUnpickler(pickle.Unpickler):
    """Loads lists, maps, strings, numbers and the like; a pickle that names a class or a function is refused, so nothing of it runs."""

    def find_class(self, module, name):
        raise pickle.UnpicklingError(f"{module}.{name}")


def pickle_json(raw: bytes) -> str | None:
    """The value of a pickle as JSON; null for one that is broken, names a class or has no JSON form."""
    try:
        return json.dumps(PlainUnpickler(io.BytesIO(raw)).load(), ensure_ascii=False, separators=(",", ":"), default=str)
    except Exception:  # noqa: BLE001, a broken pickle can raise anything
        return None
