"""Column names of the hotel review tables, for use with the general operators."""

from __future__ import annotations

from reviewlens.operators.insight import ReviewColumns

# Names in the hotel table.
SCORES = (
    "Total_Score", "Location", "Cleanliness", "Service", "Facilities", "Value_for_money", "Comfort_and_room_quality",
)
NUMBERS = (*SCORES, "comments_count")
RANK_TEXT, RANK = "Hotel_Rank", "Hotel_Rank_Num"
ID, NAME, ADDRESS, DESCRIPTION = "Hotel_ID", "Hotel_Name", "Hotel_Address", "Hotel_Description"
CRITERIA = (RANK, *SCORES)
OVERVIEW = (ID, NAME, RANK, ADDRESS, *SCORES, "comments_count")
ENTITY_COLUMNS = (ID, NAME, RANK_TEXT, ADDRESS, DESCRIPTION, *NUMBERS)

# Names in the review table, and which of its columns are used for what.
REVIEW_COLUMNS = (
    "num", "Hotel ID", "Reviewer ID", "Reviewer Name", "Nationality", "Group Name", "Room Type", "Stay Details",
    "Review Date", "Score", "Body",
)
REVIEW_DROPPED = ("num", "Reviewer_ID", "Stay_Details")
REPORT = ("Score", *SCORES)
DOCUMENT_TEXTS = (NAME, "Room_Type", ADDRESS, DESCRIPTION)

REVIEWS = ReviewColumns(
    entity=ID, name=NAME, user="Nationality", group="Group_Name", date="Review_Date", nights="Days",
    month="Month_Stay", room_type="Room_Type", score="Score", mean_score="Mean_Reviewer_Score", body="Body_clean",
)
