"""Small byte-reproducible packages for the tests."""

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml."


def rels(*rows):
    body = "".join(f'<Relationship Id="{i}" Type="{OFFICE}{t}" Target="{target}"/>' for i, t, target in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def types(*overrides):
    body = "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in overrides)
    return (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Default Extension="xml" ContentType="application/xml"/>{body}</Types>'
    )


def docx(body="<w:p><w:r><w:t>Text</w:t></w:r></w:p>", parts=None, related=(), without=()):
    files = {
        "[Content_Types].xml": types(("/word/document.xml", WORD + "document.main+xml"), ("/word/styles.xml", WORD + "styles+xml"), ("/word/comments.xml", WORD + "comments+xml")),
        "_rels/.rels": rels(("rId1", "officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": rels(("rId1", "styles", "styles.xml"), ("rId2", "comments", "comments.xml"), *related),
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Normal"/><w:style w:styleId="Head"><w:basedOn w:val="Normal"/></w:style></w:styles>',
        "word/comments.xml": f"<w:comments {W}></w:comments>",
        **(parts or {}),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            if name not in without and data is not None:
                z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def comment(*ids):
    return f"<w:comments {W}>" + "".join(f'<w:comment w:id="{i}"><w:p><w:r><w:t>Note {i}</w:t></w:r></w:p></w:comment>' for i in ids) + "</w:comments>"


def marks(i, start=True, end=True, ref=True):
    return (
        "<w:p>" + (f'<w:commentRangeStart w:id="{i}"/>' if start else "") + "<w:r><w:t>marked</w:t></w:r>"
        + (f'<w:commentRangeEnd w:id="{i}"/>' if end else "") + (f'<w:r><w:commentReference w:id="{i}"/></w:r>' if ref else "") + "</w:p>"
    )
