"""The catalogue: one query per operator, each with an SQL statement giving the same result."""
