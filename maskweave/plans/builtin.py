"""The built-in catalogue. Its order decides between equal spans."""

from __future__ import annotations

from .catalog import Field, Pattern

# Names, replacements, patterns and priorities of the built-in fields, in their order.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_FIRST_NAMES = (
    "דוד|משה|יוסף|אברהם|יעקב|יצחק|שלמה|ישראל|מאיר|אהרון|חיים|שמעון|מרדכי|בנימין|אליהו|רפאל|גדעון|אמיר|עמית|יאיר|"
    "איתי|נועם|גיא|רון|עידו|תומר|שיר|אורי|ניר|יובל|שרה|רחל|לאה|מרים|דינה|רבקה|נעמי|רות|אסתר|יעל|"
    "דבורה|חנה|תמר|רונית|מיכל|שושנה|זיוה|אורית|נורית|גילה|ליאת|מאיה|נועה|שיר|דנה|ליה|טל|עדן|אלה|יובל"
)
_FAMILY_NAMES = (
    "כהן|לוי|מזרחי|פרץ|ביטון|אברהם|פרידמן|שפירא|שמש|דוד|אוחיון|חדד|בן דוד|בן משה|גולדברג|גרינברג|וינשטיין|"
    "שלום|אלון|בר|גל|זיו|חן|טל|כץ|לם|מור|נוי|עוז|פז|רז|שן|תם|אמיר|בן ארי|גבאי|דגן|הראל|זהבי|חיימוב|"
    "טוב|יפה|כרמי|לבנה|מלכה|נגר|סלע|עמר|פלד|צור|קדם|רוזן|שגב|תורג|אבני|בכר|גפן|דרור|הוד|זמר|חפץ|טבי"
)
_DEFINITIONS = (
    ("Email Address", "[email]", (("Regex", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 100),)),
    ("Israeli ID (ת.ז.)", "[ID]", (("Regex", r"\b\d{9}\b", 100),)),
    (
        "Israeli Phone (טלפון)",
        "[PHONE]",
        (
            ("Regex", r"\b0(?:5[0-9]|7[2-9])[- ]?\d{3}[- ]?\d{4}\b", 100),
            ("Regex", r"\b0[23489][- ]?\d{3}[- ]?\d{4}\b", 90),
            ("Regex", r"\+972[- ]?(?:0)?[2-9][- ]?\d{3}[- ]?\d{4}", 95),
        ),
    ),
    (
        "Credit Card (כרטיס אשראי)",
        "[CARD]",
        (
            ("Regex", r"\b4[0-9]{3}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b", 100),
            ("Regex", r"\b5[1-5][0-9]{2}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b", 100),
            ("Regex", r"\b3[47][0-9]{2}[- ]?[0-9]{6}[- ]?[0-9]{5}\b", 100),
            ("Regex", r"\b(?:6011|65|64[4-9])[0-9]{2}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b", 90),
        ),
    ),
    (
        "Date of Birth (תאריך לידה)",
        "[DOB]",
        (
            ("Regex", r"\b(0?[1-9]|[12][0-9]|3[01])[\/\-\.](0?[1-9]|1[012])[\/\-\.](19|20)\d{2}\b", 100),
            ("Regex", r"\b(19|20)\d{2}-(0?[1-9]|1[012])-(0?[1-9]|[12][0-9]|3[01])\b", 90),
        ),
    ),
    ("Passport Number (דרכון)", "[PASSPORT]", (("Regex", r"\b[0-9]{8}\b", 80), ("Regex", r"\b[A-Z]{1,2}[0-9]{6,9}\b", 90))),
    ("IP Address", "[IP]", (("Regex", rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b", 100),)),
    ("Bank Account (חשבון בנק)", "[BANK]", (("Regex", r"\b\d{2,3}[-\/]\d{5,9}\b", 80),)),
    ("Person Name (English)", "[NAME]", (("Regex", r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Eng)\.?\s+[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){0,2}\b", 70),)),
    ("שם פרטי (עברי)", "[שם]", (("ConstList", _FIRST_NAMES, 90),)),
    ("שם משפחה (עברי)", "[משפחה]", (("ConstList", _FAMILY_NAMES, 85),)),
    (
        "IBAN / SWIFT",
        "[IBAN]",
        (
            ("Regex", r"\bIL\d{2}[0-9]{19}\b", 100),
            ("Regex", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", 70),
            ("Regex", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 65),
        ),
    ),
    ("מספר חברה / עוסק (ח.פ.)", "[ח.פ.]", (("Regex", r"(?:ח\.?פ\.?|ע\.?מ\.?|עוסק מורשה)[:\s#]*(\d{9})", 100), ("Regex", r"\b5[0-9]{8}\b", 60))),
    ("Israeli Licence Plate (לוחית רישוי)", "[PLATE]", (("Regex", r"\b\d{2,3}[-–]\d{2,3}[-–]\d{2,3}\b", 90), ("Regex", r"\b\d{7,8}\b", 50))),
)


def builtin() -> list[Field]:
    return [Field(name, tuple(Pattern(*p) for p in patterns), replace_with) for name, replace_with, patterns in _DEFINITIONS]


def named(*names: str) -> list[Field]:
    """The built-in fields whose names begin so."""
    return [f for f in builtin() if f.name.startswith(names)]
