"""Fixed value sets of the risk-code domain."""

# The 70 third-party risk codes the models carry a weight for, sorted.
RISK_CODES = (
    "02", "03", "04", "06", "07", "08", "09", "10", "11", "12", "14", "15", "16", "19",
    "25", "26", "27", "28", "29", "30", "31", "34", "37", "38", "40", "44", "48", "49",
    "50", "51", "52", "64", "66", "71", "72", "73", "74", "75", "76", "80", "82", "85",
    "89", "90", "9D", "9K", "BO", "CA", "CL", "CO", "CZ", "DI", "FQ", "FV", "IS", "IT",
    "MI", "MN", "MO", "MS", "NB", "NF", "PA", "PO", "RS", "SD", "SR", "VA", "WL", "ZI",
)

# The synthetic code for an applicant with no risk code.
NO_CODE = "NONE"

# Feature-name prefix of the one-hot risk columns.
RISK_PREFIX = "_MC_v2_"

# Letters for quintiles 1..5.
GRADE_LETTERS = ("A", "B", "C", "D", "F")

# Delinquency statuses counted in the balance-by-day report.
DQ_STATUSES = (
    "90_DAYS_PAST_DUE", "ACTIVE", "COLLECTIONS", "DEFAULT",
    "INVALID_BANKING", "NEW", "SKIP", "RECOVERY",
)

# Store numbers that mark an online approval.
ONLINE_STORE_NUMBERS = ("1000", "1001", "1002", "1003", "1004")
