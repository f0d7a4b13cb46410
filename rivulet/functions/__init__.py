"""Types, user functions and the expression compiler."""
