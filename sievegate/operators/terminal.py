"""Terminal control sequences in text, and what a screen of 200 by 48 cells would hide by painting over it.

Bytes are framed into sequences and plain runs. Both drive a screen whose rows
are objects, so that scrolling moves rows and a row keeps what was erased from
it. A cell that shows another byte than before, or a row that was erased and
shows something else at the next erasure, is a repaint. What the screen does
not follow (unknown operations, bytes beyond ASCII in a rewritten row) is a
finding as well, since a repaint could hide there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import short_batches

COLS, ROWS, MOST = 200, 48, 128

_FRAME = re.compile(
    rb"(?P<osc>(?:\x1b\]|\x9d)(?P<osc_body>.*?)(?:\x07|\x9c|\x1b\\|\Z))"
    rb"|(?P<csi>(?:\x1b\[|\x9b)(?P<body>[\x30-\x3f]*[\x20-\x2f]*)(?P<final>[\x40-\x7e]?))"
    rb"|(?P<dcs>(?:\x1bP|[\x90\x98\x9e\x9f]).*?(?:\x9c|\x1b\\|\Z))"
    rb"|(?P<string>\x1b[X^_].*?(?:\x9c|\x1b\\|\Z))"
    rb"|(?P<inter>\x1b[\x20-\x2f]+[\x30-\x7e]?)"
    rb"|(?P<single>\x1b[\x00-\xff])"
    rb"|(?P<lone>\x1b\Z)",
    re.DOTALL,
)
#: The first byte of any of them, and what plain bytes do on the screen; all others do nothing.
_FIRST = re.compile(rb"[\x1b\x90\x98\x9b\x9d-\x9f]")
_PLAIN = re.compile(rb"[\x20-\x7e\xa0-\xff]+|[\x08-\x0d]")
#: Names of control sequences by their last byte, and of the modes that h and l set.
CSI = {"K": "erase_line", "J": "erase_display", "X": "erase_chars", "m": "sgr", "H": "cursor_position", "f": "cursor_position", "A": "cursor_up", "B": "cursor_down", "C": "cursor_forward", "D": "cursor_back", "E": "cursor_next_line", "F": "cursor_prev_line", "G": "cursor_column", "`": "cursor_column", "d": "cursor_row", "S": "scroll_up", "T": "scroll_down", "L": "insert_lines", "M": "delete_lines", "P": "delete_chars", "@": "insert_chars", "r": "scroll_region", "s": "save_cursor", "u": "restore_cursor"}
MODES = {"4": "insert_mode", "?7": "decawm", "?6": "origin_mode", "?69": "declrmm", "?3": "column_mode", "20": "linefeed_mode", "?25": "cursor_visibility", "?47": "alt_screen", "?1047": "alt_screen", "?1049": "alt_screen"}
#: Names of operating system commands by number.
OSC = {0: "change_window_title", 1: "change_window_icon", 2: "change_window_title", 7: "report_pwd", 21: "kitty_color_protocol", 52: "clipboard_contents", 66: "kitty_text_sizing", 72: "kitty_dnd_protocol", 133: "semantic_prompt", 3008: "context_signal", 5522: "kitty_clipboard_protocol"}
CONEMU = {1: "conemu_sleep", 2: "conemu_show_message_box", 3: "conemu_change_tab_title", 4: "conemu_progress_report", 5: "conemu_wait_input", 6: "conemu_gui_macro", 7: "conemu_run_process", 8: "conemu_output_environment_variable", 10: "conemu_xterm_emulation", 11: "conemu_comment", 12: "semantic_prompt"}
#: Severities and what is said of them; all others are low.
RISKS = {
    "clipboard_contents": (3, "clipboard-write OSC"),
    "conemu_run_process": (3, "ConEmu automation OSC"),
    "conemu_gui_macro": (3, "ConEmu automation OSC"),
    "rxvt_extension": (3, "extension-channel OSC (clipboard/eval/file-drop)"),
    "iterm2_extension": (3, "extension-channel OSC (clipboard/eval/file-drop)"),
    "kitty_clipboard_protocol": (3, "extension-channel OSC (clipboard/eval/file-drop)"),
    "dcs": (3, "device-control string"),
    "hyperlink_start": (2, "hyperlink OSC (display/target smuggling)"),
    "hyperlink_end": (2, "hyperlink OSC (display/target smuggling)"),
    "change_window_title": (2, "window-title OSC (spoofing)"),
    "conemu_change_tab_title": (2, "window-title OSC (spoofing)"),
    "show_desktop_notification": (2, "notification OSC (spoofing)"),
    "conemu_show_message_box": (2, "notification OSC (spoofing)"),
    "report_pwd": (2, "cwd-report OSC (information leak)"),
    "kitty_dnd_protocol": (2, "terminal-mode/file-drop OSC"),
    "conemu_xterm_emulation": (2, "terminal-mode/file-drop OSC"),
    "sgr_conceal": (2, "concealed-text SGR (renders invisible)"),
    "erase_scrollback": (2, "scrollback-erase CSI (review-evidence destruction)"),
    "alt_screen": (2, "alternate-screen CSI (content leaves no scrollback)"),
    "repaint_overwrite": (2, "screen-repaint pattern (output forgery)"),
    "window_unmodeled": (2, "unmodeled terminal op (display tracking unreliable)"),
    "window_degraded": (2, "non-ASCII display content rewritten (cell tracking degraded)"),
}
_LOW = {"osc": "OSC sequence", "csi": "CSI sequence (output manipulation)", "pattern": "sequence pattern", "escape": "escape sequence"}
_NO_DISPLAY = {"sgr", "sgr_conceal", "cursor_visibility", "erase_scrollback", "set_reset_mode"}


class Sequence(NamedTuple):
    start: int
    end: int
    kind: str  # osc, csi, dcs, escape, pattern
    name: str
    detail: str


def _number(field_: bytes) -> int | None:
    return int(field_) if field_.isdigit() and int(field_) < 1 << 16 else None


def csi_name(body: bytes, final: bytes) -> str:
    params, last = body.decode("latin-1"), final.decode("latin-1")
    if last == "J" and params == "3":
        return "erase_scrollback"
    if last == "m" and "8" in params.split(";"):
        return "sgr_conceal"
    if last and last in "hl":
        return MODES.get(params, "set_reset_mode")
    return CSI.get(last, "csi_unknown")


def osc_name(payload: bytes) -> str:
    parts = payload.split(b";")
    number, second = _number(parts[0]), parts[1] if len(parts) > 1 else b""
    if number == 8:
        opens = any(len(p) > 0 for p in parts[2:3]) or any(p.startswith(b"id=") for p in second.split(b":"))
        return "hyperlink_start" if opens else "hyperlink_end"
    if number == 9:
        return CONEMU.get(_number(second), "show_desktop_notification")
    if number == 777:
        return "show_desktop_notification" if second == b"notify" else "rxvt_extension"
    if number == 1337:
        return {b"Copy": "clipboard_contents", b"CurrentDir": "report_pwd"}.get(second.split(b"=")[0], "iterm2_extension")
    if number is not None and (number in (4, 5, 104) or 10 <= number <= 19 or 110 <= number <= 119):
        return "color_operation"
    return OSC.get(number, "unclassified")


def _shown(raw: bytes) -> str:
    text = "".join(chr(b) if 32 <= b < 127 else f"\\x{b:02x}" for b in raw[:48])
    return text + ("…" if len(raw) > 48 else "")


@dataclass
class Row:
    """The bytes of a row (0: blank), where each came from, what erasures took since the last look, and whether it is beyond ASCII."""

    cells: bytearray = field(default_factory=lambda: bytearray(COLS))
    source: list[int] = field(default_factory=lambda: [0] * COLS)
    erased: dict[int, tuple[int, int]] = field(default_factory=dict)
    wide: bool = False
    told: bool = False

    def blank(self, a: int, b: int, keep: bool) -> None:
        for c in range(a, b):
            if keep and self.cells[c]:
                self.erased[c] = (self.cells[c], self.source[c])
            self.cells[c] = 0


@dataclass
class Place:
    row: int = 0
    col: int = 0
    wrap: bool = False
    origin: bool = False


class Screen:
    def __init__(self) -> None:
        self.findings: list[tuple[int, int, str, str]] = []
        self.more: tuple[int, int] | None = None
        self._reset()

    def _reset(self) -> None:
        self.grids = [[Row() for _ in range(ROWS)] for _ in range(2)]
        self.changed: list[list[tuple[int, int, int, int, int, int]]] = [[], []]  # row, column, old, its source, new, its source
        self.kept = [Place(), Place()]
        self.on, self.at = 0, Place()
        self.top, self.bottom = 0, ROWS - 1
        self.insert, self.autowrap, self.margins = False, True, False

    @property
    def rows(self) -> list[Row]:
        return self.grids[self.on]

    # -- findings

    def tell(self, start: int, end: int, name: str, detail: str) -> None:
        if len(self.findings) < MOST:
            self.findings.append((start, end, name, detail))
        elif self.more is None:
            self.more = (start, end)

    def look(self, row: Row) -> None:
        """What has become of a row, at the end of what was shown until now."""
        if row.told if row.wide else not row.erased:
            return
        live = [(row.cells[c], row.source[c]) for c in range(COLS) if row.cells[c]]
        if row.wide:
            row.told = True
            places = [s for _, s in [*row.erased.values(), *live]]
            self.tell(min(places, default=0), max(places, default=-1) + 1, "window_degraded", "non-ASCII content erased/scrolled — byte-cell tracking unreliable")
            return
        if not live:
            return
        a, b = min(row.erased), max(row.erased) + 1
        before = bytes(row.erased[c][0] if c in row.erased else 0 for c in range(a, b))
        after = bytes(row.cells).strip(b"\0")
        if before != after:
            places = [s for _, s in [*row.erased.values(), *live]]
            self.tell(min(places), max(places) + 1, "repaint_overwrite", f'repaint: "{_shown(before)}" → "{_shown(after)}"')

    def flush(self, grid: int) -> None:
        """Overwritten cells, a finding for each run of neighbours in a row."""
        run: list[tuple] = []

        def done() -> None:
            if run:
                old, new = bytes(e[2] for e in run), bytes(e[4] for e in run)
                self.tell(min(min(e[3], e[5]) for e in run), max(max(e[3], e[5]) for e in run) + 1, "repaint_overwrite", f'repaint: "{_shown(old)}" → "{_shown(new)}"')

        for e in sorted(self.changed[grid], key=lambda e: e[:2]):
            if run and not (run[-1][0] == e[0] and e[1] <= run[-1][1] + 1):
                done()
                run = []
            run.append(e)
        done()
        self.changed[grid] = []

    def review(self, grid: int) -> None:
        for row in self.grids[grid]:
            self.look(row)
        self.flush(grid)

    def finish(self) -> list[tuple[int, int, str, str]]:
        for grid in range(2):
            self.review(grid)
        if self.more is not None:
            self.findings.append((*self.more, "window_degraded", "finding cap reached — further divergence suppressed"))
        return self.findings

    # -- plain bytes

    def plain(self, raw: bytes, base: int) -> None:
        for m in _PLAIN.finditer(raw):
            b, at = raw[m.start()], self.at
            if b >= 32:
                self.write_run(m.group(), base + m.start())
            elif b == 13:
                at.col, at.wrap = 0, False
            elif b == 9:
                at.col, at.wrap = min((at.col + 8) & ~7, COLS - 1), False
            elif b == 8:
                at.col, at.wrap = max(0, at.col - 1), False
            else:
                self.down()

    def write_run(self, run: bytes, place: int) -> None:
        """``write`` of each byte; onto blank cells a row at a time."""
        done = 0
        while done < len(run):
            at = self.at
            if at.wrap and self.autowrap:
                at.wrap, at.col = False, 0
                self.step_down()
            row, a = self.rows[at.row], at.col
            b = min(COLS, a + len(run) - done)
            if self.insert or any(row.cells[a:b]):
                for i in range(done, done + b - a):
                    self.write(run[i], place + i)
                done += b - a
                continue
            part = run[done : done + b - a]
            row.cells[a:b], row.source[a:b] = part, range(place + done, place + done + b - a)
            row.wide |= not part.isascii()
            done += b - a
            if b == COLS:
                at.col, at.wrap = COLS - 1, self.autowrap or at.wrap
            else:
                at.col = b

    def write(self, b: int, place: int) -> None:
        at = self.at
        if at.wrap and self.autowrap:
            at.wrap, at.col = False, 0
            self.step_down()
        row = self.rows[at.row]
        if self.insert and at.col + 1 < COLS:
            self.shift(1, True)
        old, source = row.cells[at.col], row.source[at.col]
        row.cells[at.col], row.source[at.col] = b, place
        if old and old != b:
            if not row.wide:
                self.changed[self.on].append((at.row, at.col, old, source, b, place))
            elif not row.told:
                row.told = True
                self.tell(min(source, place), place + 1, "window_degraded", "non-ASCII content overwritten — byte-cell tracking unreliable")
        row.wide |= b >= 0x80
        if at.col == COLS - 1:
            at.wrap = self.autowrap or at.wrap
        else:
            at.col += 1

    def down(self) -> None:
        self.at.wrap = False
        self.step_down()

    def step_down(self) -> None:
        if self.at.row == self.bottom:
            self.roll(self.top, 1, False)
        else:
            self.at.row = min(self.at.row + 1, ROWS - 1)

    def up(self) -> None:
        if self.at.row == self.top:
            self.roll(self.top, 1, True)
        else:
            self.at.wrap, self.at.row = False, max(0, self.at.row - 1)

    # -- rows and cells

    def roll(self, first: int, many: int, down: bool) -> None:
        """Rows from ``first`` to the lower margin move; those that leave are looked at, blank ones come in."""
        many = min(many, self.bottom + 1 - first)
        rows = self.rows
        part = rows[first : self.bottom + 1]
        gone = part[len(part) - many :] if down else part[:many]
        for row in gone:
            self.look(row)
        self.flush(self.on)
        fresh = [Row() for _ in range(many)]
        rows[first : self.bottom + 1] = fresh + part[: len(part) - many] if down else part[many:] + fresh

    def erase(self, first: int, last: int) -> None:
        """Cells of the screen from one number to before another; each row is looked at before."""
        self.at.wrap = False
        last = min(last, ROWS * COLS)
        if first >= last:
            return
        self.flush(self.on)
        hit = range(first // COLS, (last - 1) // COLS + 1)
        for r in hit:
            self.look(self.rows[r])
        for r in hit:
            row = self.rows[r]
            row.blank(max(0, first - r * COLS), min(COLS, last - r * COLS), True)
            if not any(row.cells):
                row.wide = row.told = False

    def shift(self, many: int, right: bool) -> None:
        at, row = self.at, self.rows[self.at.row]
        at.wrap = False
        many, c = min(many, COLS - at.col), at.col
        for line, none in ((row.cells, bytes(many)), (row.source, [0] * many)):
            tail = line[c:]
            line[c:] = none + tail[: len(tail) - many] if right else tail[many:] + none

    # -- sequences

    def effective(self, name: str) -> str:
        """What an operation is in the modes that are set."""
        if name == "save_cursor" and self.margins:
            return "declrmm_margins"
        if self.at.origin and name in ("cursor_position", "cursor_row"):
            return {"cursor_position": "origin_cup", "cursor_row": "origin_vpa"}[name]
        return name

    def home(self) -> None:
        self.at.row, self.at.col, self.at.wrap = self.top if self.at.origin else 0, 0, False

    def save(self) -> None:
        self.kept[self.on] = Place(**vars(self.at))

    def restore(self) -> None:
        self.at = Place(**vars(self.kept[self.on]))

    def alternate(self, leave: bool, mode: str) -> None:
        if mode == "?1049" and not leave:
            self.save()
        if mode == "?1047" and leave and self.on:
            self.clear_other()
        self.on = 0 if leave else 1
        if mode == "?1049" and not leave:
            self.clear_other()
        elif mode == "?1049":
            self.at = Place(**vars(self.kept[0]))

    def clear_other(self) -> None:
        self.review(1)
        self.grids[1] = [Row() for _ in range(ROWS)]

    def control(self, name: str, params: str, off: bool) -> bool:
        """Carry out a control sequence; False if the screen does not follow it."""
        at = self.at
        parts = params.split(";")
        p = lambda i, default: (lambda v: default if v is None else v)(_number(parts[i].encode()) if i < len(parts) else None)
        n = p(0, 1)
        top = self.top if at.row >= self.top else 0
        bottom = self.bottom if at.row <= self.bottom else ROWS - 1
        if name.startswith("cursor_") and name != "cursor_visibility":
            at.wrap = False
            if name in ("cursor_up", "cursor_prev_line"):
                at.row = max(at.row - n, top, 0)
            elif name in ("cursor_down", "cursor_next_line"):
                at.row = min(at.row + n, bottom)
            elif name == "cursor_forward":
                at.col = min(at.col + n, COLS - 1)
            elif name == "cursor_back":
                at.col = max(at.col - n, 0)
            elif name == "cursor_column":
                at.col = min(max(n - 1, 0), COLS - 1)
            else:  # a row, or a row and a column
                at.row = min(max(n - 1, 0), ROWS - 1)
                if name == "cursor_position":
                    at.col = min(max(p(1, 1) - 1, 0), COLS - 1)
            if name.endswith("_line"):
                at.col = 0
        elif name in ("erase_line", "erase_display", "erase_chars"):
            here, line = at.row * COLS + at.col, at.row * COLS
            low, high = (line, line + COLS) if name == "erase_line" else (0, ROWS * COLS)
            if name == "erase_chars":
                self.erase(here, here + n)
            else:
                self.erase(*{0: (here, high), 1: (low, here + 1)}.get(p(0, 0), (low, high)))
        elif name in ("delete_chars", "insert_chars"):
            self.shift(n, name == "insert_chars")
        elif name in ("delete_lines", "insert_lines"):
            if self.top <= at.row <= self.bottom:
                at.col, at.wrap = 0, False
                self.roll(at.row, n, name == "insert_lines")
        elif name in ("scroll_up", "scroll_down"):
            self.roll(self.top, n, name == "scroll_down")
        elif name == "scroll_region":
            first, last = max(n, 1) - 1, min(p(1, 0) or ROWS, ROWS) - 1
            if first < last:
                self.top, self.bottom = first, last
                self.home()
        elif name == "insert_mode":
            self.insert = not off
        elif name == "decawm":
            self.autowrap = not off
        elif name == "origin_mode":
            at.origin = not off
            self.home()
            return False
        elif name == "declrmm":
            self.margins = not off
            return False
        elif name == "save_cursor":
            self.save()
        elif name == "restore_cursor":
            self.restore()
        elif name == "alt_screen":
            self.alternate(off, params)
        else:
            return name in _NO_DISPLAY
        return True

    def escape(self, b: int) -> bool:
        c = chr(b)
        if c == "c":
            for grid in range(2):
                self.review(grid)
            self._reset()
        elif c == "D":
            self.down()
        elif c == "E":
            self.at.col = 0
            self.down()
        elif c == "M":
            self.up()
        elif c == "7":
            self.save()
        elif c == "8":
            self.restore()
        else:
            return c in "=>"
        return True


def scan_bytes(raw: bytes) -> list[Sequence]:
    """Sequences in order, each followed by what the screen does not follow in it; then what the screen found."""
    out, screen, at = [], Screen(), 0
    lost = lambda m, what: out.append(Sequence(m.start(), m.end(), "pattern", "window_unmodeled", f"{what}: display state beyond this point is untracked"))
    first = _FIRST.search(raw)
    while first:
        m = _FRAME.match(raw, first.start())  # each of these bytes starts a sequence
        screen.plain(raw[at : m.start()], at)
        at = m.end()
        first = _FIRST.search(raw, at)
        if m["csi"] is not None:
            name = screen.effective(csi_name(m["body"], m["final"]))
            out.append(Sequence(m.start(), at, "csi", name, m["body"].decode("latin-1") + m["final"].decode("latin-1")))
            if not screen.control(name, m["body"].decode("latin-1"), m["final"] == b"l"):
                lost(m, f"unmodeled CSI op {name}")
        elif m["osc"] is not None:
            out.append(Sequence(m.start(), at, "osc", osc_name(m["osc_body"]), ""))
        elif m["dcs"] is not None:
            out.append(Sequence(m.start(), at, "dcs", "dcs", "ST-terminated"))
        elif m["string"] is not None:
            out.append(Sequence(m.start(), at, "escape", "escape", "ST-terminated"))
        elif m["inter"] is not None:
            out.append(Sequence(m.start(), at, "escape", "escape", "ESC intermediates"))
            lost(m, "ESC intermediates (charset/decsasd)")
        elif m["single"] is not None:
            b = m["single"][1]
            out.append(Sequence(m.start(), at, "escape", "escape", f"ESC {_shown(bytes([b]))}"))
            if not screen.escape(b):
                lost(m, "ESC op")
        else:
            out.append(Sequence(m.start(), at, "escape", "escape", "lone ESC"))
    screen.plain(raw[at:], at)
    return out + [Sequence(a, b, "pattern", name, detail) for a, b, name, detail in screen.finish()]


def hits(sequences: list[Sequence], most: int = 512) -> list[tuple[int, int, int, str, float, str]]:
    """Findings of the first ``most`` sequences."""
    out = []
    for s in sequences[:most]:
        rank, what = RISKS.get(s.name, (1, _LOW.get(s.kind, "escape sequence")))
        out.append((s.start, s.end, rank, "terminal_escape", 1.0, f"terminal {what} at bytes {s.start}..{s.end}" + (f" ({s.detail})" if s.detail else "")))
    return out


#: What the screen can tell about: escapes, C1 controls, carriage returns and backspaces.
GATE = "[\\x1b\\r\\x08\\x80-\\x9f]"
_GATE = re.compile(rb"[\x1b\r\x08\x80-\x9f]")


def terminal_hits(raw: bytes, most: int = 512, scanner: Callable[[bytes], list[Sequence]] = scan_bytes) -> list[tuple[int, int, int, str, float, str]]:
    return hits(scanner(raw), most) if scanner is not scan_bytes or _GATE.search(raw) else []


def terminal_reports(df: DataFrame, key: str = "doc_id", text: str = "text", scanner: Callable[[bytes], list[Sequence]] | None = scan_bytes, name: str = "screen", most: int = 512) -> DataFrame:
    """Per row: key, status (evaluated, skipped without a scanner, failed), scanner, sequences and findings. A scanner that raises fails its row and denies nothing."""
    short_batches(df.sparkSession)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("rank", pa.int32()), ("detector", pa.string()), ("confidence", pa.float64()), ("evidence", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, count, found = [], [], []
            for t in batch.column(1).to_pylist():
                try:
                    sequences = scanner((t or "").encode()) if scanner else []
                    status.append("evaluated" if scanner else "skipped")
                except Exception:  # noqa: BLE001 - a port may raise anything
                    sequences = []
                    status.append("failed")
                count.append(len(sequences))
                found.append([dict(zip(kind.names, h, strict=True)) for h in hits(sequences, most)])
            columns = [pa.array(status), pa.array([name] * len(status), type=pa.string()), pa.array(count, type=pa.int64()), pa.array(found, type=pa.list_(kind))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "status", "scanner", "sequences", "findings"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, status string, scanner string, sequences long, findings array<struct<start:bigint,end:bigint,rank:int,detector:string,confidence:double,evidence:string>>"
    return df.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, schema)
