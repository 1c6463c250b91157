"""Values that several test modules use."""

from __future__ import annotations

from daybook.schemas import BankProfile, CategoryRule

TZ = "Asia/Kolkata"
SMALL = "/root/testdata/sf0.001"

PROFILE = BankProfile(
    name="river_current",
    header_signature=("Booked", "Details", "Out", "In"),
    date_col="Booked",
    narration_col="Details",
    amount_style="debit_credit",
    debit_col="Out",
    credit_col="In",
    date_format="%d-%m-%Y",
)
RULES = [
    CategoryRule("mill|bakery", "bread"),
    CategoryRule("ferry", "travel"),
    CategoryRule("atm", "cash"),
]
