"""Self-contained HTML pages: a review page of results, and a datasheet. They load nothing and send nothing."""

from __future__ import annotations

import hashlib
import html
import json
import secrets
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import preview
from ..operators.tables import datasheet_notes, filled_columns

FIXED = ("file", "characters")
_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:3px 7px;text-align:left;vertical-align:top}th{background:#eee;position:sticky;top:0;cursor:pointer}td[contenteditable]{background:#fffdf0}.bad{color:#a00}.edited{background:#cfc}details{max-width:60em}pre{white-space:pre-wrap}"
_SCRIPT = """
const page = JSON.parse(document.getElementById('data').textContent), table = document.querySelector('table'), store = 'review-' + page.key;
const saved = JSON.parse(sessionStorage.getItem(store) || '{}');
for (const cell of table.querySelectorAll('td[data-at]')) {
  if (cell.dataset.at in saved) { cell.textContent = saved[cell.dataset.at]; cell.classList.add('edited'); }
  cell.oninput = () => { saved[cell.dataset.at] = cell.textContent; cell.classList.add('edited'); sessionStorage.setItem(store, JSON.stringify(saved)); };
}
const rows = () => [...table.tBodies[0].rows];
document.getElementById('filter').oninput = e => { const q = e.target.value.toLowerCase(); rows().forEach(r => r.hidden = !r.textContent.toLowerCase().includes(q)); };
[...table.tHead.rows[0].cells].forEach((h, k) => h.onclick = () => {
  const up = h.dataset.up = h.dataset.up === '1' ? '0' : '1', text = r => r.cells[k].textContent, number = r => Number(text(r).replace(/,/g, ''));
  const numeric = rows().every(r => text(r) === '' || !isNaN(number(r)));
  rows().sort((a, b) => (up === '1' ? 1 : -1) * (numeric ? number(a) - number(b) : text(a).localeCompare(text(b)))).forEach(r => table.tBodies[0].append(r));
});
const plain = /^-[$\\u00a3\\u20ac]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\\.[0-9]+)?%?$/;
const safe = s => '=+-@\\t\\r'.includes(s[0] || ' ') && !(plain.test(s) && !s.includes('\\n')) ? "'" + s : s;
const quoted = s => /[",\\r\\n]/.test(s) ? '"' + s.replace(/"/g, '""') + '"' : s;
document.getElementById('export').onclick = () => {
  const lines = [page.columns, ...rows().map(r => page.columns.map((_, k) => r.cells[k].dataset.full ?? r.cells[k].textContent))];
  const link = document.createElement('a');
  link.href = URL.createObjectURL(new Blob(['\\ufeff' + lines.map(l => l.map(v => quoted(safe(v))).join(',')).join('\\r\\n')], {type: 'text/csv'}));
  link.download = 'corrected.csv'; link.click();
};
"""


def embedded(value: object) -> str:
    """JSON that can't end the script element it stands in."""
    text = json.dumps(value, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _page(title: str, body: str, data: object) -> str:
    return (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}'
        f'<script type="application/json" id="data">{embedded(data)}</script><script>{_SCRIPT}</script></body></html>'
    )


def _table(columns: list[str], rows: list[list[str]], editable: frozenset[int] = frozenset()) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join(
        "<tr>" + "".join(f'<td contenteditable data-at="{r}.{k}">{html.escape(v)}</td>' if k in editable else f"<td>{html.escape(v)}</td>" for k, v in enumerate(row)) + "</tr>" for r, row in enumerate(rows)
    )
    return f'<p><input id="filter" placeholder="filter"> <button id="export">export CSV</button></p><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>'


def _strings(table: DataFrame, columns: list[str]) -> list[list[str]]:
    return [["" if v is None else str(v) for v in r] for r in table.select(*[F.col(f"`{c}`") for c in columns]).toLocalIterator()]


def write_review(results: DataFrame, exceptions: DataFrame, path: str | Path, title: str = "Review") -> None:
    """Results with cells to correct, previews of the texts, and what wasn't read. A page is for people: its rows come to
    the driver."""
    columns = [c for c in results.columns if c != "text"]
    rows = _strings(results, columns)
    unread = _strings(exceptions, ["file", "reason", "detail"])
    found = len(columns) > len(FIXED)
    editable = frozenset(k for k, c in enumerate(columns) if c not in FIXED)
    total = len(rows) + len(unread)
    stats = f"<p>{len(rows)} read, {len(unread)} not read ({100 * len(rows) / total if total else 0:.1f} % read), {len(editable)} fields</p>"
    parts = [stats, "" if found else '<p class="bad">no fields matched</p>', _table(columns, rows, editable)]
    if unread:
        items = "".join(f"<tr><td>{html.escape(a)}</td><td>{html.escape(b)}</td><td>{html.escape(c)}</td></tr>" for a, b, c in unread)
        parts.append(f'<h2 class="bad">Not read</h2><table class="x"><thead><tr><th>file</th><th>reason</th><th>detail</th></tr></thead><tbody>{items}</tbody></table>')
    if "text" in results.columns:
        parts.append("<h2>Texts</h2>")
        for name, text in results.select("file", preview("text")).toLocalIterator():
            parts.append(f"<details><summary>{html.escape(name)}</summary><pre>{html.escape(text or '')}</pre></details>")
    key = hashlib.sha256(repr((columns, rows)).encode()).hexdigest()[:16] + secrets.token_hex(4)
    Path(path).write_text(_page(title, "".join(parts), {"key": key, "columns": columns}), encoding="utf-8")


def write_datasheet(sheet: DataFrame, path: str | Path, title: str = "Datasheet") -> None:
    columns = filled_columns(sheet)
    notes = datasheet_notes(sheet).head()
    said = []
    if notes.members:
        said.append(f"{notes.members} members of archives: their times have no zone, and owners aren't recorded")
    if notes.unreliable:
        said.append(f"{notes.unreliable} files on file systems without owners of their own")
    if notes.no_created:
        said.append(f"{notes.no_created} files without a recorded creation time")
    body = "".join(f"<p>{html.escape(x)}</p>" for x in said) + _table(columns, _strings(sheet, columns))
    Path(path).write_text(_page(title, body, {"key": "sheet", "columns": columns}), encoding="utf-8")
