"""Readers and sniffing, on documents built here."""

import io
import time
import zipfile
import zlib

import pytest

from folioforge.plans import rendered
from folioforge.sources import sniff
from folioforge.sources.limits import LIMITS, ArchiveTooLarge, Budget, StreamTooLarge, inflate, read_member
from folioforge.sources.readers import mail, markup, office, pdf, pdf_fonts, plain

LINES = ["First (1)", "Second & <more>", "Third: {x}"]


def archive(parts: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def page(content: bytes, extra: bytes = b"") -> bytes:
    return b"%PDF-1.4\n" + extra + b"1 0 obj << /Length 1 >> stream\n" + content + b"\nendstream endobj\n%%EOF"


@pytest.mark.parametrize("kind", rendered.FORMATS)
def test_each_format_is_told_and_read(kind):
    data, named = rendered.FORMATS[kind](LINES), kind
    kind = kind.rpartition(".")[2]
    assert sniff.sniff(data, f"x.{named}") == kind
    text = sniff.extract(data, f"x.{kind}")
    assert all(x in text for x in LINES)
    assert sniff.read(data, f"x.{kind}").status == "read"
    if kind not in ("csv", "json"):
        assert sniff.sniff(data, "misnamed.txt") == kind


def test_decoding_ladder():
    assert plain.decode(b"\xef\xbb\xbfa\xc3\xa9") == "aé" and plain.decode(b"\x93x\x94 \x80") == "“x” €" and plain.decode(b"\x81\xe9") == "\x81é"


def test_delimited_text():
    assert plain.read_delimited(b'a;b\n"x;1"; y \n\n') == "a\tb\nx;1\ty"
    assert plain.read_delimited(b"a\tb\nc\td\n") == "a\tb\nc\td"


def test_json_paths():
    assert plain.read_json(b'{"b": {"c": [1, {"d": true}]}, "a": null, "e": "x"}') == "b.c[0]: 1\nb.c[1].d: True\ne: x"
    assert plain.read_json(b"7") == "7" and plain.read_json(b"{bad") == "{bad" and plain.read_json(b"[" * 5000) == "[" * 5000


def test_html():
    assert markup.read_html(b"<head><title>t</title></head><p>a  b<br>c</p><script>x</script>d &eacute;<img src=x>e<div>f</div>") == "a b\nc\nd ée\nf"


def test_xml_texts_and_fallback():
    assert markup.read_xml(b"<a>one<b>two</b>three<c/>four</a>") == "one\ntwo\nthree\nfour"
    assert markup.read_xml(b"<a>one<b>two</a>") == "onetwo"


def test_rtf_groups():
    data = rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\generator Word;}{\info{\author Me}}Caf\'e9\par \{x\}\tab y\line z\page w}"
    assert markup.read_rtf(data) == "Café\n{x}\ty\nz\n\nw"


def test_message():
    text = mail.read_message(
        b"From: a@b.c\r\nSubject: Hi\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=X\r\n\r\n--X\r\nContent-Type: text/html\r\n\r\n<p>Rich</p>\r\n--X\r\nContent-Type: text/plain\r\n\r\nPlain\r\n--X\r\nContent-Type: text/csv\r\nContent-Disposition: attachment; filename=t.csv\r\n\r\n1,2\r\n--X--\r\n"
    )
    assert text == "From: a@b.c\nSubject: Hi\n\nPlain\n\nAttachments: t.csv"


def test_headers_are_parsed_once(monkeypatch):
    asked = []
    parse = mail._parse
    mail._parsed.cache_clear()
    monkeypatch.setattr(mail, "_parsed", mail.lru_cache(9)(lambda name, value: asked.append(name) or parse(name, value)))
    for k in range(20):
        text = mail.read_message(f"From: \"Doe, J\" <j@x.org>\nTo: a@b.co\nSubject: No  {k}\nContent-Type: text/plain; charset=utf-8\n\nbody".encode())
        assert text == f'From: "Doe, J" <j@x.org>\nTo: a@b.co\nSubject: No  {k}\n\nbody'
    assert sorted(asked) == ["Content-Type", "From", "To"]
    assert mail.read_message(b"Subject: =?utf-8?q?caf=C3=A9?= x\nFrom: a@b.co\n\n") == "From: a@b.co\nSubject: caf\u00e9 x"


def test_mailbox():
    text = mail.read_mailbox(b"From a\nSubject: One\n\nbody 1\nFrom b\nSubject: Two\n\nbody 2\n")
    assert text == "--- message 1 ---\nSubject: One\n\nbody 1\n--- message 2 ---\nSubject: Two\n\nbody 2"


def test_office_details():
    deck = archive({"ppt/presentation.xml": "<p/>", **{f"ppt/slides/slide{k}.xml": f"<s><p><t>n{k}</t></p></s>" for k in (10, 9)}})
    assert office.read_pptx(deck) == "--- slide 9 ---\nn9\n--- slide 10 ---\nn10"
    doc = archive({"word/document.xml": "<d><p><t>a</t><tab/><t>b</t></p><p> </p></d>", "word/footer1.xml": "<f><p><t>foot</t></p></f>", "word/header2.xml": "<broken"})
    assert office.read_docx(doc) == "a\tb\nfoot"
    book = archive({"xl/workbook.xml": "<w/>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>5</v></c><c t="inlineStr"><is><t>in</t></is></c></row><row><c><v> </v></c></row></w>'})
    assert office.read_xlsx(book) == "\tin"


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (b"BT (Hello) Tj ET", "Hello"), (b"BT [(He) (llo)] TJ ET", "Hello"), (b"BT (a (b) c) Tj ET", "a (b) c"), (rb"BT (a\)b\\) Tj ET", "a)b\\"), (rb"BT (\101\0501\051) Tj ET", "A(1)"), (b"BT <48656C6C6F> Tj ET", "Hello"),
        (b"BT <485> Tj ET", "HP"), (b"BT (a) Tj 0 -12 Td (b) Tj ET", "a\nb"), (b"BT [(two) -250 (words)] TJ ET", "two words"), (b"BT [(ker) -20 (ned)] TJ ET", "kerned"), (b"BT [(a) -120 -100 (b)] TJ ET", "a b"),
        (b"BT (a) Tj -500 (b) Tj ET", "ab"), (b"BT [(a ) -500 (b)] TJ ET", "a b"), (b"BT (x) Tj (y) ' ET", "x\ny"), (rb"BT (li\ ne) Tj ET".replace(b"\\ ", b"\\\n"), "line"),
    ],
)
def test_pdf_operators(content, want):
    assert pdf.read_pdf(page(content)) == want
    assert pdf.read_pdf(b"junk before" + page(content)) == want


def test_pdf_character_maps():
    cmap = b"beginbfchar <01> <0048> <02> <00660069> endbfchar beginbfrange <03> <05> <0061> <06> <07> [<0078> <0079>] endbfrange"
    objects = b"5 0 obj << /Type /Font /ToUnicode 6 0 R >> endobj 6 0 obj << >> stream\n" + cmap + b"\nendstream endobj 7 0 obj << /Font << /F1 5 0 R >> >> endobj\n"
    assert pdf_fonts.code_map(cmap) == {1: "H", 2: "fi", 3: "a", 4: "b", 5: "c", 6: "x", 7: "y"}
    assert pdf.read_pdf(page(b"BT /F1 9 Tf <01020304050607> Tj ET", objects)) == "Hfiabcxy"
    assert pdf_fonts.through({1: "a"}, b"\0\1\0\1") == "aa" and pdf_fonts.through({1: "a"}, b"zz") is None


def test_pdf_packed_objects():
    body = b"8 0 << /ToUnicode 9 0 R >>"
    data = b"3 0 obj << /Type /ObjStm /N 1 /First 4 >> stream\n" + body + b"\nendstream endobj"
    assert pdf_fonts.objects(data)[8] == b" << /ToUnicode 9 0 R >>"[1:] or b"<< /ToUnicode 9 0 R >>" in pdf_fonts.objects(data)[8]


@pytest.mark.parametrize(
    ("data", "name", "status"),
    [
        (b"", "zero.pdf", "empty_file"), (b"%PDF-1.4 1 0 obj << /Length 9 >> stream\nBT (x", "cut.pdf", "truncated_or_corrupt"), (page(b"q Q", b"<< /Subtype /Image >>"), "scan.pdf", "no_text_found"), (b" \n\t", "blank.txt", "no_text_found"),
        (page(b"x") + b"trailer << /Encrypt 4 0 R >>", "locked.pdf", "encrypted"), (page(b"BT <0102030405> Tj ET"), "glyphs.pdf", "undecodable_fonts"), (b"\x01\x00\x02", "noise.xyz", "unsupported_format"),
        (archive({"a.txt": "x"}), "hollow.docx", "unsupported_format"), (archive({"word/document.xml": "<d><p>"}), "broken.docx", "truncated_or_corrupt"), (archive({"word/document.xml": b"x" * 9_000_000}), "bomb.docx", "archive_bomb"),
    ],
)
def test_causes(data, name, status):
    out = sniff.read(data, name)
    assert (out.status, out.text) == (status, "")
    assert out.detail


def test_entities_that_expand_are_refused():
    lol = "".join(f'<!ENTITY l{k} "{f"&l{k - 1};" * 10}">' for k in range(1, 10))
    data = archive({"word/document.xml": f'<!DOCTYPE d [<!ENTITY l0 "lol">{lol}]><d><p><t>&l9;</t></p></d>'})
    assert sniff.read(data, "x.docx").status in ("limit_exceeded", "truncated_or_corrupt")


def test_sniffing_order():
    assert sniff.sniff(b"a,b\nSubject: x\n", "x.csv") == "eml" and sniff.sniff(b"  <!DocType HTML>") == "html" and sniff.sniff(b"\n<?xml ?>") == "xml" and sniff.sniff(b"From x") == "mbox"
    assert sniff.sniff(b"plain", "x.pdf") == "text" and sniff.sniff(b"plain", "x.tsv") == "csv" and sniff.sniff(b"plain") == "text"
    assert sniff.skip_reason("a.PNG", b"\x89PNG")[0] == "image_no_text_layer" and sniff.skip_reason("a.so", b"\x7fELF")[0] == "not_a_document"
    assert sniff.skip_reason("a.png", b"%PDF-1.4") is None and sniff.skip_reason("a.txt", b"x") is None
    assert sniff.skip_reason("a.jar", b"PK", lambda: rendered.docx(LINES)) is None and sniff.skip_reason("a.jar", b"PK", lambda: archive({"x": "y"}))


def test_bounds():
    z = zipfile.ZipFile(io.BytesIO(archive({"a": b"0" * 3_000_000, "b": b"small"})))
    with pytest.raises(ArchiveTooLarge):
        read_member(z, z.getinfo("a"))
    with pytest.raises(ArchiveTooLarge):
        read_member(z, z.getinfo("b"), Budget(3))
    info = z.getinfo("a")
    info.file_size = 10
    with pytest.raises((ArchiveTooLarge, zipfile.BadZipFile)):
        read_member(z, info)
    with pytest.raises(StreamTooLarge):
        inflate(zlib.compress(b"0" * 100_000), LIMITS.__class__(pdf_stream_bytes=1000))


@pytest.mark.parametrize(
    ("read", "unit"), [(pdf.read_pdf, b"("), (pdf.read_pdf, b"<<"), (pdf.read_pdf, b"1 0 obj "), (pdf.read_pdf, b"stream "), (markup.read_rtf, b"{\\par "), (markup.read_html, b"<div>"), (mail.read_mailbox, b"From \n"), (plain.read_delimited, b'"')]
)
def test_time_grows_in_proportion(read, unit):
    def cost(n):
        data = unit * (n // len(unit))
        data = page(b"BT " + data + b" Tj ET") if read is pdf.read_pdf else data
        t = time.process_time()
        try:
            read(data)
        except Exception:  # noqa: BLE001
            pass
        return time.process_time() - t

    cost(1000)
    assert cost(64_000) < 24 * max(cost(8000), 0.01)
