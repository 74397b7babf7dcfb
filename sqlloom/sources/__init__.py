"""Reading of tables, attachments and archives."""
