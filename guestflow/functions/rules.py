"""Rule tables and fixed texts.

FIXED VALUES. Everything in this module must equal the values the message
service uses, or classification, scores, routing and replies come out
different. Keep them in their natural order: the class order decides which
class wins, and the keyword order decides what the trace reports first.
"""

# --- FIXED VALUES: inbound channels, in the order the payload schema lists them.
CHANNELS = ["whatsapp", "booking_com", "airbnb", "instagram", "direct"]

# --- FIXED VALUES: ordered intent classes and their keywords (first class wins).
CLASS_RULES = [
    ("complaint", [
        "unhappy", "unacceptable", "refund", "complaint", "not working",
        "broken", "disgusting", "terrible", "awful", "worst", "angry",
        "disappointed", "no hot water", "no water", "no ac", "no wifi",
        "not acceptable", "want a refund", "demand", "3am", "emergency",
    ]),
    ("pre_sales_availability", [
        "available", "availability", "vacancy", "free", "dates",
        "april", "may", "june", "july", "august", "book", "booking",
        "when can", "is it open",
    ]),
    ("pre_sales_pricing", [
        "price", "rate", "cost", "how much", "per night", "charge",
        "fee", "pricing", "quote", "total", "adults", "persons", "people",
    ]),
    ("post_sales_checkin", [
        "check in", "check-in", "checkin", "check out", "checkout",
        "wifi", "wi-fi", "password", "what time", "arrival", "key",
        "access", "entry", "directions", "address", "caretaker",
    ]),
    ("special_request", [
        "early", "late", "transfer", "airport", "pickup", "drop",
        "arrange", "request", "special", "chef", "cook", "meal",
        "birthday", "anniversary", "decoration", "surprise",
    ]),
    ("general_enquiry", [
        "pets", "dog", "cat", "parking", "car", "pool", "gym",
        "beach", "nearby", "restaurant", "market", "policy", "rules",
    ]),
]

# --- FIXED VALUES: class used when no keyword matches.
FALLBACK_CLASS = "general_enquiry"

QUERY_TYPES = [name for name, _ in CLASS_RULES]

# --- FIXED VALUES: base score per class, in hundredths
# (post_sales_checkin .95, availability .90, pricing .88, special .75,
#  general .72, complaint .40; anything else .70).
BASE_SCORE_CENTS = {
    "post_sales_checkin": 95,
    "pre_sales_availability": 90,
    "pre_sales_pricing": 88,
    "special_request": 75,
    "general_enquiry": 72,
    "complaint": 40,
}
DEFAULT_SCORE_CENTS = 70

# --- FIXED VALUES: multi-intent pairs (all terms present → one −0.08 penalty).
MULTI_INTENT_PAIRS = [
    ["available", "rate"],
    ["available", "price"],
    ["check in", "wifi"],
    ["early", "transfer"],
    ["price", "availability"],
    ["book", "cost"],
]
MULTI_INTENT_PENALTY_CENTS = 8

# --- FIXED VALUES: ambiguity phrases (any present → one −0.10 penalty).
AMBIGUITY_PHRASES = [
    "maybe", "not sure", "thinking about", "possibly",
    "might", "could you", "wondering", "just checking",
]
AMBIGUITY_PENALTY_CENTS = 10

# --- FIXED VALUES: score clamp and routing thresholds, in hundredths.
SCORE_FLOOR_CENTS = 10
SCORE_CEIL_CENTS = 100
AUTO_SEND_CENTS = 85
AGENT_REVIEW_CENTS = 60

ACTIONS = ["auto_send", "agent_review", "escalate"]

# --- FIXED VALUES: the holding reply, split around the guest's first name.
FALLBACK_REPLY_HEAD = "Hi "
FALLBACK_REPLY_TAIL = (
    ", thank you for reaching out. "
    "Our team has received your message and will get back to you shortly. "
    "We appreciate your patience."
)

# --- FIXED VALUES: prompt pieces.
NO_BOOKING_TEXT = "Not provided — likely a pre-sales enquiry"
NO_PROPERTY_TEXT = "Property details unavailable."
MAX_REPLY_TOKENS = 500

# --- FIXED VALUES: validation envelope texts.
ERROR_TITLE = "Request validation failed"
ERROR_HINT = ("Check field types, required fields, and enum values "
              "against the schema at /docs")
FIELD_PATH_SEP = " → "

# Our own choices below (documented in README): model label, system text,
# band names, complaint topics and the default SLA windows.
DEFAULT_MODEL = "drafter-v1"
MODEL_VERSIONS = ["drafter-v1", "drafter-v2"]

SYSTEM_PROMPT = (
    "You draft replies to guests of a villa rental company. "
    "Greet the guest by first name, keep it short and warm, "
    "use only the property facts given, never make facts up, "
    "and match the tone to the query type: informative for availability "
    "and pricing, clear for check-in, accommodating for special requests, "
    "empathetic for complaints, helpful for general questions. "
    "If the facts do not answer the question, say so and offer to put "
    "the guest in touch with the team."
)

# Confidence bands, lower bound inclusive, highest first.
CONFIDENCE_BANDS = [
    (90, "deterministic"),
    (85, "high"),
    (70, "medium"),
    (55, "low"),
]
BAND_COMPLAINT = "complaint"
BAND_BELOW = "very_low"

# Complaint topic for same-type complaint rules; first match wins.
COMPLAINT_TOPICS = ["no hot water", "no water", "no ac", "no wifi",
                    "not working", "broken"]
OTHER_TOPIC = "other"

ESCALATION_STATUSES = ["open", "assigned", "in_progress", "resolved", "closed"]
CLOSED_STATUSES = ["resolved", "closed"]

# --- FIXED VALUES: layout of the user prompt, line by line; {name} is filled in.
PROMPT_LINES = [
    "Guest Name: {first_name}",
    "Channel: {source}",
    "Query Type: {query_type}",
    "Booking Reference: {booking_ref}",
    "",
    "Property Details:",
    "{property_text}",
    "",
    "Guest Message:",
    "{message}",
    "",
    "Draft a reply to this guest message. Follow the tone guidelines",
    "for the query type above. Address the guest as {first_name}.",
]

# --- FIXED VALUES: layout of the property facts, line by line; {name} is filled in.
# (The rate lines carry our own unit text because our table stores numbers.)
PROPERTY_LINES = [
    "Property: {name}",
    "Bedrooms: {bedrooms} | Max Guests: {max_guests} | Private Pool: {private_pool}",
    "Check-in: {check_in_time} | Check-out: {check_out_time}",
    "Base Rate: INR {base_rate_inr} per night",
    "Extra Guest Rate: INR {extra_guest_rate_inr} per night per additional guest",
    "WiFi Password: {wifi_password}",
    "Caretaker: {caretaker_hours}",
    "Chef on Call: {chef_available}",
    "Availability (April 20-24): {availability_april_20_24}",
    "Cancellation Policy: {cancellation_policy}",
]
MISSING_FACT = "Not on file"
