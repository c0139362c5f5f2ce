"""Trial-portfolio analytics as plain DataFrame -> DataFrame operators."""
