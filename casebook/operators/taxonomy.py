"""Label taxonomies as data."""

from __future__ import annotations

# The group names.
PAYMENT = "Payment & Repayment Issues"
SERVICING = "Loan Information & Servicing"
CREDIT = "Credit Reporting Issues"
ACQUISITION = "Loan Acquisition & Eligibility"
OTHER = "Other"

# Issue label -> group.
ISSUE_GROUPS = {
    "Dealing with your lender or servicer": SERVICING,
    "Struggling to repay your loan": PAYMENT,
    "Incorrect information on your report": CREDIT,
    "Improper use of your report": CREDIT,
    "Problem with a company's investigation into an existing problem": CREDIT,
    "Unable to get your credit report or credit score": CREDIT,
    "Problem with a credit reporting company's investigation into an existing problem": CREDIT,
    "Getting a loan": ACQUISITION,
    "Issue where my lender is my school": ACQUISITION,
    "Issue with income share agreement": ACQUISITION,
}

# The issues whose training rows are augmented.
AUGMENTED_ISSUES = [
    "Getting a loan",
    "Issue where my lender is my school",
    "Issue with income share agreement",
]

# Group -> its sub-issue labels.
SUB_ISSUES = {
    PAYMENT: [
        "Trouble with how payments are being handled",
        "Don't agree with the fees charged",
        "Problem with your payment plan",
        "Can't get other flexible options for repaying your loan",
        "Can't temporarily delay making payments",
        "Problem lowering your monthly payments",
        "Issues with fees connected to the loan",
        "Payment issues",
        "Billing or statement issues",
        "Billing dispute for services",
    ],
    SERVICING: [
        "Received bad information about your loan",
        "Problem with customer service",
        "Need information about your loan balance or loan terms",
        "Problem with forgiveness, cancellation, or discharge",
        "Changes in terms mid-deal or after closing",
        "Problem with the interest rate",
        "Marketing or disclosure issues",
        "Confusing or misleading advertising",
        "High pressure sales tactics or recruiting",
        "Didn't receive services that were advertised",
        "Issues with financial aid services",
        "Problem with product or service terms changing",
        "Problem with signing the paperwork",
        "Dealing with provider of income share agreement",
    ],
    CREDIT: [
        "Account information incorrect",
        "Account status incorrect",
        "Reporting company used your report improperly",
        "Their investigation did not fix an error on your report",
        "Information belongs to someone else",
        "Old information reappears or never goes away",
        "Personal information incorrect",
        "Credit inquiries on your report that you don't recognize",
        "Was not notified of investigation status or results",
        "Investigation took more than 30 days",
        "Information is missing that should be on the report",
        "Public record information inaccurate",
        "Other problem getting your report or credit score",
        "Problem getting your free annual credit report",
        "Problem canceling credit monitoring or identify theft protection service",
        "Report provided to employer without your written authorization",
        "Problem with personal statement of dispute",
        "Difficulty submitting a dispute or getting information about a dispute over the phone",
    ],
    ACQUISITION: [
        "Co-signer",
        "Denied loan",
        "Loan opened without my consent or knowledge",
        "Fraudulent loan",
        "Qualified for a better loan than the one offered",
        "Bankruptcy",
        "Cannot graduate, receive diploma, or get transcript due to money owed",
        "Keep getting calls about your loan",
        "Received unwanted marketing or advertising",
        "Received unsolicited financial product or insurance offers after opting out",
    ],
}
SUB_ISSUE_GROUPS = {label: group for group, labels in SUB_ISSUES.items() for label in labels}

# The alternative grouping of the four groups into two.
BROAD_GROUPS = {
    CREDIT: "Non-Servicing Issues",
    ACQUISITION: "Non-Servicing Issues",
    SERVICING: "Loan Servicing & Payments",
    PAYMENT: "Loan Servicing & Payments",
}
