"""Reports for people: HTML, whose rows executors write, and terminal texts."""

from __future__ import annotations

import html
import logging
import sys
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from roadgrid import config as C
from roadgrid.functions import text as X
from roadgrid.sources.files import write_text
from roadgrid.sources.images import export

COLOURS = {"red": "\033[91m", "green": "\033[92m", "yellow": "\033[93m", "magenta": "\033[95m", "none": ""}


def report_rows(results: DataFrame, position: Column) -> DataFrame:
    """Result rows with the report's derived cells; position counts from 1."""
    return results.withColumns(
        {
            "idx": position - 1,
            "crop_rel": F.when(F.col("crop_path") != "", F.concat(F.lit("crops/"), X.basename(F.col("crop_path")))).otherwise(""),
            "original_rel": F.when(F.col("image") != "", F.concat(F.lit("../input/"), F.col("image"))).otherwise(""),
            "confidence_percent": X.confidence_percent(F.col("ocr_confidence")),
            "label": X.status_label(F.col("status")),
            "label_class": X.status_class(F.col("status")),
        }
    )


def search(rows: DataFrame, status: str = "all", query: str = "") -> DataFrame:
    """Rows of the status (all: any) with the query in plate or image, in either case."""
    if status != "all":
        rows = rows.where(F.col("status") == status)
    wanted = F.lower(F.lit(query))
    return rows.where(F.contains(F.lower("plate_text"), wanted) | F.contains(F.lower("image"), wanted))


def no_plate_preview(images: DataFrame, key: str = "image", n: int = 6) -> DataFrame:
    """name, more: the first n names, cut to 48 characters, and how many more there are. Nothing runs until rows are asked for."""
    total = images.agg(F.count("*").alias("n")).scalar()
    names = images.orderBy(key).limit(n).select(X.clipped(F.col(key), 48).alias("name"))
    return names.withColumn("more", F.greatest(total - n, F.lit(0)).cast("long"))


def paint(text: str, colour: str, tty: bool | None = None) -> str:
    tty = sys.stdout.isatty() if tty is None else tty
    return f"{COLOURS[colour]}{text}\033[0m" if tty and COLOURS.get(colour) else text


def stolen_line(row: Row, tty: bool | None = None) -> str:
    return paint(f"Placa {row['plate_text']}  arquivo {row['image']}", "red", tty)


def summary(metrics: Row, mode: str, requested: int, effective: int, warmup: float, stolen: Iterable[Row] = (), tty: bool | None = None) -> str:
    """The run's summary as lines of text."""
    m = metrics.asDict()
    workers = str(effective) if requested == effective else f"{effective} (solicitado: {requested})"
    # The labels of the summary.
    out = [
        ("Modo", mode.upper()),
        ("Workers", workers),
        ("Imagens", m["total_images"]),
        ("Warm-up", f"{warmup:.4f} s"),
        ("Tempo total", f"{m['total_processing_time_s']:.4f} s"),
        ("Média por imagem", f"{m['avg_time_per_image_s']:.4f} s"),
        ("Throughput", f"{m['throughput_img_per_s']:.2f} img/s"),
    ]
    whole = m["yolo_stage_time_s"] + m["ocr_stage_time_s"]
    if whole > 0:
        out += [(k, f"{m[c]:.2f} s ({m[c] / whole * 100:.1f}%)") for k, c in (("Detecção", "yolo_stage_time_s"), ("Leitura", "ocr_stage_time_s"))]
    out += [
        ("Com placa", m["images_with_plate"]),
        ("Sem placa", m["images_without_plate"]),
        ("Status OK", m["ok_count"]),
        ("Status ROUBADO", m["roubado_count"]),
        ("Não identificado", m["nao_identificada_count"]),
    ]
    if m["error_count"]:
        out.append(("Erros", m["error_count"]))
    lines = [f"{k:<18}: {v}" for k, v in out]
    if m["roubado_count"]:
        lines.append(paint(f"ALERTA: {m['roubado_count']} VEÍCULO(S) ROUBADO(S) IDENTIFICADO(S)", "red", tty))
        lines += [stolen_line(r, tty) for r in stolen]
    return "\n".join(lines)


_STYLE = "body{font:14px sans-serif;margin:2em}.cards{display:flex;gap:1em}.cards div{border:1px solid #ccc;padding:1em}.stolen{background:#fdd}.ok{color:#080}td,th{padding:.3em .8em;text-align:left}dialog img{max-width:38vw;margin:.5em}button.on{font-weight:bold}dt{float:left;width:9em;color:#666}"

#: Rows of a page, files over which the index is dealt, rows that the report shows at once.
PAGE_ROWS, SHARDS, SHOWN = 500, 256, 200

#: The search, apart from what is on the screen: get(kind, number) gives a page's rows or a part of the index.
SEARCH = """
const lower = r => [r.plate_text.toLowerCase(), r.image.toLowerCase()];
const fits = (r, status, query) => (status === 'all' || r.status === status) && lower(r).some(t => t.includes(query));
function grams(query) {
  const c = Array.from(query), found = [];
  for (let k = 0; k + 3 <= c.length; k++) found.push(c.slice(k, k + 3).join(''));
  return found;
}
const shardOf = gram => Array.from(gram).reduce((n, c) => (n * 31 + c.codePointAt(0)) % SHARDS, 0);
const all = n => Array.from({length: n}, (_, k) => k);
async function candidates(get, pages, status, query) {
  let left = all(pages);
  const keep = list => { const own = new Set(list); left = left.filter(k => own.has(k)); };
  if (status !== 'all') keep((await get('status', 0))[status] || []);
  for (const gram of grams(query)) {
    const list = (await get('index', shardOf(gram)))[gram] || null;
    if (list === null) return [];
    if (list.length) keep(list);  // an empty list: the gram is on most pages
  }
  return left;
}
async function* search(get, pages, status, query) {
  query = query.toLowerCase();
  for (const k of await candidates(get, pages, status, query))
    for (const r of await get('page', k)) if (fits(r, status, query)) yield r;
}
"""
_SCRIPT = """
const held = new Map(), waiting = new Map(), body = document.querySelector('tbody');
function arrived(kind, number, value) { held.set(kind + number, value); }
function get(kind, number) {
  const key = kind + number;
  if (held.has(key)) return Promise.resolve(held.get(key));
  if (!waiting.has(key)) waiting.set(key, new Promise((done, failed) => {
    const s = document.createElement('script');
    s.src = 'pages/' + kind + '-' + String(number).padStart(9, '0') + '.js';
    s.onload = () => { if (!held.has(key)) held.set(key, kind === 'page' ? [] : {}); done(held.get(key)); };
    s.onerror = () => { held.set(key, kind === 'page' ? [] : {}); done(held.get(key)); };
    document.head.appendChild(s);
  }));
  return waiting.get(key);
}
const cell = (tr, text) => { const td = tr.insertCell(); td.textContent = text; return td; };
let status = 'all', turn = 0, rest = null;
async function more() {
  const own = turn;
  for (let n = 0; n < SHOWN; n++) {
    const next = await rest.next();
    if (own !== turn) return;
    document.getElementById('more').hidden = next.done;
    if (next.done) return;
    const r = next.value, tr = body.insertRow();
    tr.className = r.label_class;
    for (const v of [r.image, r.plate_text || '—', r.label, r.confidence_percent + '%', r.total_time_s.toFixed(3) + 's', r.worker_id || '—']) cell(tr, v);
    tr.onclick = () => detail(r);
  }
}
function show() {
  turn++;
  body.replaceChildren();
  rest = search(get, PAGES, status, document.getElementById('query').value);
  more();
}
function detail(r) {
  const d = document.querySelector('dialog'), list = d.querySelector('dl');
  for (const img of d.querySelectorAll('img')) {
    img.hidden = !r[img.dataset.of];
    if (r[img.dataset.of]) img.src = r[img.dataset.of];
  }
  list.replaceChildren();
  const fields = [['Arquivo', r.image], ['Placa', r.plate_text || '—'], ['Status', r.label], ['Confiança', r.confidence_percent + '%'], ['Detecção', r.yolo_time_s.toFixed(3) + 's'],
    ['Leitura', r.ocr_time_s.toFixed(3) + 's'], ['Tempo', r.total_time_s.toFixed(3) + 's'], ['Worker', r.worker_id || '—'], ['Erro', r.error || '—']];
  for (const [name, value] of fields) {
    list.appendChild(document.createElement('dt')).textContent = name;
    list.appendChild(document.createElement('dd')).textContent = value;
  }
  d.showModal();
}
function choose(wanted) {
  status = wanted;
  for (const x of document.querySelectorAll('button[data-status]')) x.classList.toggle('on', x.dataset.status === wanted);
  show();
}
for (const b of document.querySelectorAll('button[data-status]')) b.onclick = () => choose(b.dataset.status);
for (const b of document.querySelectorAll('section.stolen button')) b.onclick = () => choose('ROUBADO');
document.getElementById('query').oninput = show;
document.getElementById('more').onclick = more;
show();
"""


def _file(kind: str, number: Column, value: Column) -> list[Column]:
    """name, content of a script that hands value over to the report."""
    name = F.concat(F.lit(f"{kind}-"), F.lpad(number.cast("string"), 9, "0"), F.lit(".js"))
    text = F.concat(F.lit(f"arrived('{kind}',"), number.cast("string"), F.lit(","), value, F.lit(");"))
    return [name.alias("name"), F.encode(text, "utf-8").alias("content")]


def page_files(rows: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    """name, content of the report's pages of rows, size by idx each. rows come from report_rows(), idx counts them from 0."""
    prepared = F.when(F.col("preprocessed_path") != "", F.concat(F.lit("preprocessed/"), X.basename(F.col("preprocessed_path")))).otherwise("")
    times, pictures = ["yolo_time_s", "ocr_time_s", "total_time_s"], ["original_rel", "crop_rel", "preprocessed_rel"]
    columns = ["idx", "image", "plate_text", "status", "label", "label_class", "confidence_percent", *times, "worker_id", *pictures, "error"]
    one = rows.withColumn("preprocessed_rel", prepared).select(F.floor(F.col("idx") / size).cast("long").alias("page"), "idx", X.json_row(*columns).alias("j"))
    pages = one.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("idx", "j"))).alias("rows"))
    return pages.select(*_file("page", F.col("page"), F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit("]"))))


def _postings(found: DataFrame, kind: str, shard: Column, pages: int | None = None) -> DataFrame:
    """Files of the pages by key: JSON objects of sorted lists, by shard. With pages, a key on over half of them has an empty list: every page."""
    lists = found.distinct().groupBy("key").agg(F.array_sort(F.collect_list("page")).alias("on"))
    if pages is not None:
        lists = lists.withColumn("on", F.when(F.size("on") * 2 > pages, F.array().cast("array<bigint>")).otherwise(F.col("on")))
    one = lists.groupBy(shard.alias("shard")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "on")))).alias("j"))
    return one.select(*_file(kind, F.col("shard"), F.col("j")))


def index_files(rows: DataFrame, pages: int, size: int = PAGE_ROWS) -> DataFrame:
    """name, content of the index: the pages of every three characters of plates and names, and those of every status."""
    paged = rows.select(F.floor(F.col("idx") / size).cast("long").alias("page"), "status", "plate_text", "image")
    text = paged.select("page", F.explode(F.array(F.lower("plate_text"), F.lower("image"))).alias("t")).where(F.length("t") > 2).distinct()
    grams = text.select("page", F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda k: F.substring(F.col("t"), k, F.lit(3)))).alias("key"))
    code = lambda k: F.ascii(F.substring("key", k, 1))
    shard = ((code(1) * 31 + code(2)) * 31 + code(3)) % SHARDS
    return _postings(grams, "index", shard, pages).union(_postings(paged.select("page", F.col("status").alias("key")), "status", F.lit(0)))


def html_shell(metrics: Row, pages: int, mode: str, requested: int, effective: int, when: str) -> str:
    """The report's page without rows; it loads those that it shows."""
    m = metrics.asDict()
    # The labels of the cards.
    cards = {
        "Tempo Total": f"{m['total_processing_time_s']:.2f}s", "Imagens / s": f"{m['throughput_img_per_s']:.2f}", "Imagens Processadas": m["total_images"],
        "Workers Efetivos": effective if requested == effective else f"{effective} (solicitado: {requested})", "Status OK": m["ok_count"], "Roubados Detectados": m["roubado_count"],
    }
    buttons = "".join(f'<button data-status="{s}">{html.escape(label)}</button> ' for s, label in (("all", "Todos"), *C.STATUS_LABELS.items()))
    images = "".join(f'<img alt="" data-of="{p}">' for p in ("original_rel", "crop_rel", "preprocessed_rel"))
    n = m["roubado_count"]
    stolen = f'<section class="stolen"><h2>ALERTA: {n} VEÍCULO(S) ROUBADO(S)</h2><button>Mostrar</button></section>' if n else ""
    sizes = f"const PAGES = {pages}, SHARDS = {SHARDS}, SHOWN = {SHOWN};"
    return (
        f'<!DOCTYPE html><html lang="pt-BR"><meta charset="utf-8"><title>Relatório de placas</title><style>{_STYLE}</style>'
        f"<h1>Relatório de placas</h1><p>{html.escape(mode)} · {html.escape(when)}</p>"
        f'<div class="cards">{"".join(f"<div><b>{html.escape(str(v))}</b><br>{html.escape(k)}</div>" for k, v in cards.items())}</div>{stolen}'
        f'<p>{buttons}<input id="query" placeholder="placa ou arquivo"></p>'
        "<table><thead><tr><th>Arquivo<th>Placa<th>Status<th>Confiança<th>Tempo<th>Worker</tr></thead><tbody></tbody></table>"
        f'<p><button id="more" hidden>Mais</button></p><dialog>{images}<dl></dl><form method="dialog"><button>Fechar</button></form></dialog>'
        f"<script>{sizes}{SEARCH}{_SCRIPT}</script></html>"
    )


def html_report(rows: DataFrame, metrics: Row, folder: str, mode: str, requested: int, effective: int, when: str, size: int = PAGE_ROWS) -> int:
    """Writes the report of rows, which come from report_rows(): folder/report.html, and its pages and index beside it; how many pages.

    Executors write the pages, each of so many rows, and the index by which the
    report finds those that can have what is searched for. The driver writes the
    frame around them and sees no row.
    """
    pages = -(-metrics["total_images"] // size)
    export(page_files(rows, size), f"{folder}/pages", "name", "content")
    export(index_files(rows, pages, size), f"{folder}/pages", "name", "content")
    write_text(rows.sparkSession, f"{folder}/report.html", html_shell(metrics, pages, mode, requested, effective, when))
    return pages


def logger(name: str = "roadgrid", verbose: bool = False, quiet: bool = False) -> logging.Logger:
    """A logger of messages alone, set up once; quiet goes before verbose."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.WARNING if quiet else logging.DEBUG if verbose else logging.INFO)
    return log
