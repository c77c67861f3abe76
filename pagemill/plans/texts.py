"""What each built-in rule is about and asks for, in English; a rule file may bring its own words."""

from __future__ import annotations

#: Rule: (what it is about, what is expected).
TEXTS = {
    "PKG-001": ("package", "a readable package with content types and a main part"),
    "PKG-002": ("copy", "the reviewed copy keeps everything but the added comments"),
    "PAGE-001": ("section", "A4, 8.27 by 11.69 inches, portrait"),
    "PAGE-002": ("section", "margins of 1.77 inches above and 1.10 inches elsewhere"),
    "PAGE-003": ("section", "the header 42.55 and the footer 48.2 points from the edge"),
    "PAGE-004": ("page numbers", "Arabic numbers from 1 where the main matter begins"),
    "HF-001": ("header", "the university's line in the set font and size"),
    "HF-002": ("header", "red text over two red rules"),
    "HF-003": ("footer", "a centred page number"),
    "HF-004": ("header and footer", "a main matter that shows a header and a footer of its own or its predecessor's"),
    "COVER-001": ("title", "a Chinese title of at most 30 characters"),
    "COVER-002": ("title", "an English title that says what the Chinese one says"),
    "COVER-003": ("author", "the author's name in the order that the language asks for"),
    "FRONT-001": ("declarations", "both declarations before the main matter"),
    "FONT-001": ("text", "Song for Chinese, Times New Roman for Latin letters and digits, 12 points"),
    "FONT-002": ("text", "black letters"),
    "FONT-003": ("text", "each script of a mixed run in its own font"),
    "PARA-001": ("paragraph", "justified, with 1.5 lines"),
    "PARA-002": ("paragraph", "distances by format, not by empty paragraphs or repeated spaces"),
    "PARA-003": ("page break", "breaks that leave no large blank areas"),
    "HEAD-001": ("heading 1", "bold Hei of 16 points, centred, numbered in one level"),
    "HEAD-002": ("heading 2", "bold Hei of 14 points, numbered in two levels"),
    "HEAD-003": ("heading 3", "bold Hei of 12 points, numbered in three levels"),
    "HEAD-004": ("headings", "no level left out, numbers without gaps, one way of numbering"),
    "HEAD-005": ("heading", "a title that says what the section is about"),
    "ABS-001": ("Chinese abstract", "500 to 600 Chinese characters"),
    "ABS-002": ("Chinese abstract", "12 points"),
    "ABS-003": ("English abstract", "12 points, 1.5 lines"),
    "ABS-004": ("keywords", "three to eight, parted by the full-width semicolon, no mark at the end"),
    "ABS-005": ("abstracts", "the same content in both languages"),
    "ABS-006": ("abstracts", "no first person, figures or formulas"),
    "TOC-001": ("contents", "a contents field"),
    "TOC-002": ("contents", "14 points, lines of 25 points"),
    "TOC-003": ("contents", "page numbers brought up to date"),
    "FIG-001": ("figure", "figures in line with the text"),
    "FIG-002": ("caption of a figure", "below its figure, centred, no mark at the end"),
    "FIG-003": ("figure", "legible, with its units"),
    "FIG-004": ("figure", "named in the text"),
    "FIG-005": ("figure", "a figure that needs no text to be understood"),
    "TAB-001": ("table", "three rules and no vertical ones"),
    "TAB-002": ("caption of a table", "above its table, centred, no mark at the end"),
    "TAB-003": ("cells", "10.5 points, heads without a mark at the end"),
    "TAB-004": ("table", "a head that repeats on every page of a long table"),
    "TAB-005": ("note of a table", "10.5 points"),
    "TAB-006": ("table", "complete units and numbers"),
    "EQ-001": ("equation", "centred, or set by tabs"),
    "EQ-002": ("equation", "a number such as (2-1) at the end of the line"),
    "NOTE-001": ("footnote", "Song of 9 points, single lines, no indent"),
    "NOTE-002": ("footnotes", "numbers that begin anew on every page"),
    "NOTE-003": ("footnote", "page ranges in the set form"),
    "NOTE-004": ("footnote", "addresses with the date of access"),
    "REF-001": ("references", "numbers from 1 without gaps, and an entry for each citation"),
    "REF-002": ("reference", "at most six authors, then et al."),
    "REF-003": ("reference", "no mark at the end"),
    "REF-004": ("book", "the parts of a book in the set order"),
    "REF-005": ("article", "the parts of an article in the set order"),
    "REF-006": ("paper", "the conference and the year"),
    "REF-007": ("patent", "country, number and year"),
    "REF-008": ("thesis", "kind of thesis, place, school and year"),
    "REF-009": ("references", "at least 40 entries"),
    "REF-010": ("reference", "initials with full stops"),
    "REF-011": ("references", "enough foreign and recent entries"),
    "OBJ-001": ("objects", "nothing that covers text"),
    "OBJ-002": ("cross-reference", "a target that exists"),
    "OBJ-003": ("changes", "no open changes, controls or comments"),
    "LANG-001": ("language", "consistent terms, symbols and units"),
    "LANG-002": ("abbreviation", "the full name where it first appears"),
    "LANG-003": ("unit", "a space between number and unit"),
    "STRUCT-001": ("structure", "at least five chapters and 25,000 characters"),
    "STRUCT-002": ("structure", "a summary in each chapter but the first and the last"),
    "APP-001": ("achievements", "only those of the author's studies"),
    "APP-002": ("achievements", "the same form as the references"),
    "APP-003": ("appendix", "content that belongs to no chapter"),
    "RENDER-001": ("layout", "no blank or broken pages"),
    "RENDER-002": ("header and footer", "the same place on every page"),
    "RENDER-003": ("legibility", "nothing cut off or covered"),
}

#: What to do, by the first part of a rule's name.
ADVICE = {
    "PKG": "stop using the copy and make it again", "PAGE": "set the page in the section's page setup", "HF": "mend the header or footer of the section", "COVER": "compare with the cover page of the template",
    "FRONT": "take the missing page from the template", "FONT": "apply the style of body text and clear direct formats", "PARA": "apply the style of body text and clear direct formats", "HEAD": "apply the heading style of the level",
    "ABS": "compare with the abstract pages of the template", "TOC": "make the contents anew from the headings", "FIG": "compare with the template's figures", "TAB": "compare with the template's tables",
    "EQ": "compare with the template's equations", "NOTE": "mend the style and the options of footnotes", "REF": "compare with the template's list of references", "OBJ": "look at the object in Word",
    "LANG": "read the place again", "STRUCT": "compare with the required structure", "APP": "compare with the template's appendix", "RENDER": "look at the pages in Word",
}
