"""Generated PDFs whose fonts have codes of their own."""

import random
import zlib

from tessella.sources import archives, pdf_text


def _stream(body: bytes, head: bytes = b"", packed: bool = True) -> bytes:
    data = zlib.compress(body) if packed else body
    return b"<<" + head + b" /Length %d>>\nstream\n" % len(data) + data + b"\nendstream"


def _cmap(*blocks: bytes) -> bytes:
    return b"/CIDInit /ProcSet findresource begin begincmap\n" + b"\n".join(blocks) + b"\nendcmap"


TWO = _cmap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange", b"2 beginbfchar <0003> <0020> <0010> <00660069> endbfchar", b"3 beginbfrange <0041> <005A> <0410> <0100> <0102> [<4E00> <D83DDE00> <0041>] <0200> <02FF> <0061> endbfrange")
ONE = _cmap(b"1 begincodespacerange <00> <FF> endcodespacerange", b"1 beginbfrange <01> <1A> <0061> endbfrange")


def _file(objects: dict[int, bytes]) -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects.items())


def test_fonts_by_page(tmp_path, spark):
    pack = {10: b"<</Type /Page /Parent 2 0 R /Contents [20 0 R 21 0 R]>>", 11: b"<</Type/Page/Parent 2 0 R/Resources<</ProcSet[/PDF]/Font<</F1 6 0 R>>>>/Contents 22 0 R>>"}
    head = " ".join(f"{n} {sum(len(b) + 1 for b in list(pack.values())[:i])}" for i, n in enumerate(pack)).encode() + b" "
    objects = {
        2: b"<</Type /Pages /Kids [10 0 R 11 0 R] /Resources 3 0 R>>", 3: b"<</Font 4 0 R>>", 4: b"<</F1 5 0 R /F2 7 0 R>>",
        5: b"<</Type/Font/Subtype/Type0/ToUnicode 8 0 R>>", 6: b"<</Type /Font /ToUnicode 9 0 R>>", 7: b"<</Type/Font/Subtype/Type1>>",
        8: _stream(TWO), 9: _stream(ONE, packed=False), 12: _stream(head + b" ".join(pack.values()), b"/Type /ObjStm /N 2 /First %d" % len(head)),
        20: _stream(b"BT /F1 12 Tf [<00410042> -250 <0003> (\\000\\020)] TJ <010001010102> Tj ET"),
        21: _stream(b"BT /F2 9 Tf (plain \\(x\\) \\101 a(b)c) Tj T* /F1 1 Tf (\\002\\000\\002\\001) ' 0 0 (\\377\\377\\000A) \" ET", packed=False),
        22: _stream(b"q BT /F1 12 Tf <08 05 0C 0C 0F> Tj () Tj ET Q"),
    }
    (tmp_path / "a.pdf").write_bytes(_file(objects))
    (tmp_path / "b.pdf").write_bytes(b"no file")
    rows = archives.read_parts(spark, str(tmp_path), "pdf").orderBy("path", "ordinal").collect()
    assert [r["content"] for r in rows] == ["\u0410\u0411 fi \u4e00\U0001f600A", "plain (x) A a(b)c ab \u0410", "hello ", None] and rows[-1]["error"]


def test_every_code():
    rng = random.Random(1)
    texts = {c: chr(rng.choice([*range(0x20, 0xD7FF), *range(0x10000, 0x11000)])) for c in rng.sample(range(65_536), 3_000)}
    chars = b"".join(b"<%04X> <%s>\n" % (c, t.encode("utf-16-be").hex().encode()) for c, t in texts.items())
    ranges = b"<00> <7F> <0400>"  # of one byte, beside codes of two
    m = pdf_text.CodeMap(_cmap(b"beginbfchar " + chars + b" endbfchar"))
    codes = [rng.choice(list(texts)) for _ in range(5_000)]
    assert m.decode(b"".join(c.to_bytes(2) for c in codes)) == "".join(texts[c] for c in codes)
    mixed = pdf_text.CodeMap(_cmap(b"1 begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange", b"beginbfrange " + ranges + b" endbfrange beginbfchar <8001> <0041> endbfchar"))
    assert mixed.decode(b"\x00\x80\x01\x7f") == "\u0400A\u047f"
    assert pdf_text.CodeMap(b"").decode(b"abc") == "" and m.decode(b"") == ""
