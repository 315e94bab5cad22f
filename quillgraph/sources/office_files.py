"""Plain DOCX, PPTX and PDF files from pages of (title, text)."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

# The namespaces of the formats.
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SHOW = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_LINKS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            archive.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


def docx(pages: list) -> bytes:
    """A heading and a paragraph for each page."""
    body = []
    for n, (title, text) in enumerate(pages):
        skip = '<w:r><w:br w:type="page"/></w:r>' if n else ""
        body.append(f'<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr>{skip}<w:r><w:t>{escape(title)}</w:t></w:r></w:p>')
        body.append(f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>')
    styles = f'<w:styles {_WORD}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return _archive({"word/document.xml": f'<w:document {_WORD}><w:body>{"".join(body)}</w:body></w:document>', "word/styles.xml": styles})


def pptx(pages: list) -> bytes:
    """A slide with a title and a text for each page."""
    parts, ids, links = {}, [], []
    for n, (title, text) in enumerate(pages, 1):
        shape = '<p:sp><p:nvSpPr><p:nvPr>{}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:txBody></p:sp>'
        parts[f"ppt/slides/slide{n}.xml"] = f'<p:sld {_SHOW}><p:cSld><p:spTree>{shape.format("<p:ph type=\"title\"/>", escape(title))}{shape.format("", escape(text))}</p:spTree></p:cSld></p:sld>'
        ids.append(f'<p:sldId id="{255 + n}" r:id="rId{n}"/>')
        links.append(f'<Relationship Id="rId{n}" Target="slides/slide{n}.xml"/>')
    parts["ppt/presentation.xml"] = f'<p:presentation {_SHOW}><p:sldIdLst>{"".join(ids)}</p:sldIdLst></p:presentation>'
    parts["ppt/_rels/presentation.xml.rels"] = f'<Relationships {_LINKS}>{"".join(links)}</Relationships>'
    return _archive(parts)


def pdf(pages: list) -> bytes:
    """A title line and a text line for each page, in codes of the Windows encoding; white space is a space."""
    code = lambda s: b"(" + " ".join(s.split()).encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    kids = " ".join(f"{4 + 2 * n} 0 R" for n in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /Resources << /Font << /F1 3 0 R >> >> >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for n, (title, text) in enumerate(pages):
        data = zlib.compress(b"BT /F1 12 Tf 72 720 Td " + code(title) + b" Tj 0 -14 Td [" + code(text) + b"] TJ ET")
        objects.append(f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * n} 0 R >>".encode())
        objects.append(f"<< /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream")
    out, at = bytearray(b"%PDF-1.4\n"), []
    for n, own in enumerate(objects, 1):
        at.append(len(out))
        out += f"{n} 0 obj\n".encode() + own + b"\nendobj\n"
    table = "".join(f"{x:010d} 00000 n \n" for x in at)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    return bytes(out)


WRITERS = {"docx": docx, "pptx": pptx, "pdf": pdf}
