"""Messages of failed checks. Callers compare them, so they are what existing users of such checks expect."""

INVALID = "is invalid"
BLANK = "can't be blank"
FORMAT = "has invalid format"
RESERVED = "is reserved"
SUBSET = "has an invalid entry"
CONFIRMATION = "does not match confirmation"
ACCEPTANCE = "must be accepted"
TAKEN = "has already been taken"
NO_SUCH = "does not exist"
STILL_ONE = "is still associated with this entry"
STILL_MANY = "are still associated with this entry"
EXCLUSION = "violates an exclusion constraint"
STALE = "is stale"
LENGTH = {
    "is": "should {verb} {n} {what}",
    "min": "should {verb} at least {n} {what}",
    "max": "should {verb} at most {n} {what}",
}
NUMBER = {
    "less_than": "must be less than {}",
    "greater_than": "must be greater than {}",
    "less_than_or_equal_to": "must be less than or equal to {}",
    "greater_than_or_equal_to": "must be greater than or equal to {}",
    "equal_to": "must be equal to {}",
    "not_equal_to": "must be not equal to {}",
}
