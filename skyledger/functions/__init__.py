"""Column expressions shared by the operators; nothing here touches Python at run time."""
