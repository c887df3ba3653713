"""Clean and unsafe files for the scan."""

from palimpsest.sources import build as b


def clean_pdf() -> bytes:
    return b.pdf(b.show("Reviewed copy", 72, 720))


def unsafe_pdf() -> bytes:
    content = b.show("Quarterly numbers", 72, 720) + b.show("Card 4111111111111111", 72, 650) + "0 g 68 645 250 20 re f\n"
    content += b.show("api_key=abcdef0123456789", 72, 600, "BT 3 Tr ET") + b.show("someone@example.com", 72, 560, "1 g")
    note = "6 0 obj\n<< /Type /Annot /Subtype /Text /Contents (Ask legal first) >>\nendobj\n"
    return b.pdf(content, {"Author": "Finance Desk", "Creator": "Writer"}, note, revisions=2)


def clean_pptx() -> bytes:
    return b.pptx([b.slide([b.shape("Title", "Reviewed copy")])])


def unsafe_pptx() -> bytes:
    crop = '<a:blip r:embed="rId3"/><a:srcRect l="12000" r="18000"/>'
    first = b.slide([
        b.shape("Title", "Draft"), b.shape("Hidden box", "api_key=demo_secret_987654321", hidden=True),
        b.shape("Aside", "some.person@example.com", x=13_000_000), b.shape("Photo", "", kind="pic", inner=crop, descr="A photo")])
    rels = b.relationships(("rId2", "notesSlide", "../notesSlides/notesSlide1.xml", False), ("rId3", "image", "../media/image1.png", False),
                           ("rId5", "hyperlink", "https://u:p@portal.example.test/share?token=private_token_123456789#x", True),
                           ("rId6", "oleObject", "file:///Users/someone/model.xlsx", True))
    return b.pptx([first, b.slide([b.shape("Title", "Secret plan")], hidden=True)], {
        "ppt/slides/_rels/slide1.xml.rels": rels,
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {b.P}><a:t>Margin is 41%. Write to other.person@example.com</a:t></p:notes>",
        "ppt/commentAuthors.xml": '<p:cmAuthorLst><p:cmAuthor id="0" name="A Reviewer"/></p:cmAuthorLst>',
        "ppt/comments/comment1.xml": '<p:cmLst><p:cm authorId="0"><p:text>Remove this before sending.</p:text></p:cm></p:cmLst>',
        "ppt/media/image1.png": b.png({"Author": "Photo Desk"}), "ppt/embeddings/book.xlsx": b"0" * 64,
        "customXml/item1.xml": "<internal><project>Cobalt</project></internal>",
        "docProps/core.xml": "<c><dc:creator>Strategy Team</dc:creator><cp:lastModifiedBy>A. Editor</cp:lastModifiedBy></c>",
        "docProps/app.xml": "<Properties><Company>Example Holdings</Company></Properties>",
        "docProps/custom.xml": '<Properties><property name="Class"><vt:lpwstr>Internal</vt:lpwstr></property></Properties>'})
