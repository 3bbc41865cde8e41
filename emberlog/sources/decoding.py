"""Decoding of one report."""

from __future__ import annotations

import json

import pyarrow as pa

from emberlog import schema

_TEXT = pa.string()
_FAILURE = pa.struct([(k, _TEXT) for k in ("task", "package", "recipe", "log", "kind")])
DECODED_TYPE = [("problem", _TEXT), *((k, _TEXT) for k in schema.BUILD_FIELDS), ("failures", pa.list_(_FAILURE)), ("local_conf", _TEXT), ("auto_conf", _TEXT), ("raw", _TEXT)]
DECODED_FIELDS = f"problem string, {', '.join(f'{k} string' for k in schema.BUILD_FIELDS)}, failures array<{schema.FAILURE}>, local_conf string, auto_conf string, raw string"


def text(value: object) -> str | None:
    """Strings as they are, other JSON values as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def decode(content: bytes | str | None) -> dict:
    """One report. Whatever is no UTF-8 JSON object gets a problem and no failures."""
    try:
        data = json.loads(content.decode("utf-8") if isinstance(content, bytes) else content or "")
    except UnicodeDecodeError as e:
        return {"problem": f"Could not read report: {e}", "failures": []}
    except json.JSONDecodeError as e:
        return {"problem": f"Report is not valid JSON: {e}", "failures": []}
    if not isinstance(data, dict):
        return {"problem": f"Report is not a JSON object (got {type(data).__name__})", "failures": []}
    listed = data.get("failures")
    failures = []
    for f in listed if isinstance(listed, list) else ():
        if isinstance(f, dict):
            task, log = f.get("task"), f.get("log")
            named = isinstance(task, str) and task.startswith("do_")
            failures.append(
                {
                    "task": text(task),
                    "package": text(f.get("package")),
                    "recipe": text(f.get("recipe")),
                    "log": log if isinstance(log, str) else "",
                    "kind": "task" if named else "message",
                }
            )
    conf = {k: v for k in ("local_conf", "auto_conf") if isinstance(v := data.get(k), str)}
    rest = json.dumps({k: v for k, v in data.items() if k != "failures"}, ensure_ascii=True)
    return {"failures": failures, **{k: text(data.get(k)) for k in schema.BUILD_FIELDS}, **conf, "raw": rest}
