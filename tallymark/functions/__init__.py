"""Column functions: text, money, dates, identity, roles and policy text."""
