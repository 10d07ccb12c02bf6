"""A plain sequential reading of the drawing rules, for comparison only."""

from __future__ import annotations

import math

IDENT = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def fmt(v: float) -> str:
    if not math.isfinite(v):
        return "0"
    scaled = v * 10_000
    whole = math.floor(abs(scaled) + 0.5) * (1 if scaled >= 0 else -1)
    text = f"{whole / 10_000:.4f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


def rect(a) -> str:
    return f"M {fmt(a[0])} {fmt(a[1])} h {fmt(a[2])} v {fmt(a[3])} h {fmt(-a[2])} Z"


def closed(d: str) -> str:
    parts = [p if p.rstrip().endswith("Z") or not p.strip() else p + " Z" for p in d.split(" M ")]
    return " M ".join(parts)


class Path:
    def __init__(self, d="", cur=False):
        self.d, self.cur = d, cur

    def add(self, text):
        self.d = f"{self.d} {text}" if self.d else text

    def command(self, kind, a):
        letters = {"move_to": ("M", 2), "line_to": ("L", 2), "bezier_curve_to": ("C", 6), "quadratic_curve_to": ("Q", 4)}
        if kind == "begin_path":
            self.d, self.cur = "", False
        elif kind == "close_path":
            self.add("Z")
        elif kind == "rect":
            self.add(rect(a))
            self.cur = True
        elif kind in letters:
            letter, n = letters[kind]
            self.add(" ".join([letter, *map(fmt, a[:n])]))
            self.cur = True
        elif kind == "arc":
            cx, cy, r, start, end = a[:5]
            anti = len(a) > 5 and a[5] != 0
            at = lambda t: f"{fmt(cx + r * math.cos(t))} {fmt(cy + r * math.sin(t))}"
            turn = end - start
            if anti and turn > 0:
                turn -= math.tau
            if not anti and turn < 0:
                turn += math.tau
            if not self.cur:
                self.add("M " + at(start))
            sweep = 0 if anti else 1
            head = f"A {fmt(r)} {fmt(r)} 0"
            if abs(turn) >= math.tau - 1e-7:
                self.add(f"{head} 1 {sweep} {at(start + (-math.pi if anti else math.pi))}")
                self.add(f"{head} 1 {sweep} {at(end)}")
            else:
                self.add(f"{head} {1 if abs(turn) > math.pi else 0} {sweep} {at(end)}")
            self.cur = True


class Canvas:
    def __init__(self, e):
        self.w = max(e["width"] if e["width"] is not None else 1.0, 1.0)
        self.h = max(e["height"] if e["height"] is not None else 1.0, 1.0)
        self.visible, self.revision = True, 0
        self.clip, self.stack = None, []
        self.wipe()

    def wipe(self):
        self.ops, self.shapes, self.strokes, self.errors = [], 0, 0, 0


def fold(events, cap=5000):
    """Canvases by id and the text of every copy and append, from events in sequence order."""
    paths, canvases, refs = {}, {}, {}
    for e in sorted(events, key=lambda r: (r["frame_id"], r["sequence"])):
        kind, pid = e["type"], e["path_id"]
        if kind == "session_end":
            continue
        if kind == "path_created":
            value = e["value"]
            if value and value.startswith("{"):
                src = paths.get(eval(value)["source_path_id"])
                new = Path(src.d, src.cur) if src else Path()
                refs[e["sequence"]] = new.d
            else:
                new = Path(value or "")
            paths.setdefault(pid, new)
        if kind == "path_command":
            paths.setdefault(pid, Path()).command(e["command"]["type"], e["command"]["args"])
        if kind == "path_append":
            src = paths.get(eval(e["value"])["source_path_id"])
            if src and src.d:
                refs[e["sequence"]] = src.d
                paths.setdefault(pid, Path()).add(src.d)
        cid = e["canvas_id"]
        if kind == "canvas_created" and cid not in canvases:
            canvases[cid] = Canvas(e)
        c = canvases.get(cid)
        if c is None:
            continue
        c.revision += 1
        c.w = max(e["width"], 1.0) if e["width"] is not None else c.w
        c.h = max(e["height"], 1.0) if e["height"] is not None else c.h
        m = e["transform"] or IDENT
        a = e["args"]
        if kind == "canvas_resized":
            c.wipe()
            c.clip, c.stack = None, []
        elif kind == "canvas_visibility" and e["value"] in ("true", "false"):
            c.visible = e["value"] == "true"
        elif kind == "save":
            c.stack.append(c.clip)
        elif kind == "restore" and c.stack:
            c.clip = c.stack.pop()
        elif kind == "clip":
            if pid is None:
                c.errors += 1
            else:
                c.clip = (closed(paths[pid].d), m) if pid in paths else None
        elif kind == "clear_rect" and a and len(a) >= 4:
            det = m[0] * m[3] - m[1] * m[2]
            if a[2] == 0 or a[3] == 0 or det == 0:
                continue
            xs, ys = sorted((a[0], a[0] + a[2])), sorted((a[1], a[1] + a[3]))

            def inside(x, y, m=m, det=det, xs=xs, ys=ys):
                lx = (m[3] * (x - m[4]) - m[2] * (y - m[5])) / det
                ly = (-m[1] * (x - m[4]) + m[0] * (y - m[5])) / det
                return xs[0] - 1e-9 <= lx <= xs[1] + 1e-9 and ys[0] - 1e-9 <= ly <= ys[1] + 1e-9

            if c.clip is None and all(inside(x, y) for x in (0, c.w) for y in (0, c.h)):
                c.wipe()
            elif c.shapes + c.strokes:
                c.ops.append(("clear", rect(a), None, c.clip))
        elif kind in ("fill", "fill_rect", "stroke", "stroke_rect"):
            shape = kind.startswith("fill")
            if (c.shapes if shape else c.strokes) >= cap:
                continue
            paint = (e["fill_style"] if shape else e["stroke_style"]) or "#000"
            if kind.endswith("rect"):
                d = rect(a) if a and len(a) >= 4 else None
            else:
                d = paths[pid].d if pid in paths else None
                if d == "":
                    continue
                d = closed(d) if d is not None and shape else d
            if d is None:
                c.errors += 1
                continue
            c.ops.append(("shape" if shape else "stroke", d, paint, c.clip))
            if shape:
                c.shapes += 1
            else:
                c.strokes += 1
    return canvases, refs
