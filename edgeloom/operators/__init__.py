"""Graph operators over edge DataFrames."""
